"""Queries that plant a value of each rule in the rows of a table, and mask them with the whole rule pipeline.

A case is a sentence with a value made from the row's key, by an expression that Spark and DuckDB both read, and the category
that it must be masked as; a case without one must stay as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.config import MaskConfig
from maskspark.operators import documents


@dataclass(frozen=True)
class Case:
    name: str
    before: str
    value: str  # an SQL expression over k, the key as text
    after: str
    cat: str | None


def _padded(n: int, sign: str = "7") -> str:
    """The key as n characters."""
    return f"lpad(k, {n}, '{sign}')"


def _pick(values: list[str]) -> str:
    """One of the values, by the key."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE CAST(k AS INTEGER) % {len(values)} {whens} ELSE '{values[-1]}' END"


def _id18(body: str) -> str:
    """With its check digit: by weights 2^(17 - i) modulo 11."""
    return body + "10X98765432"[sum(int(c) * 2 ** (17 - i) for i, c in enumerate(body)) % 11]


def _uscc(body: str) -> str:
    """With its check character: by weights 3^i modulo 31."""
    signs = "0123456789ABCDEFGHJKLMNPQRTUWXY"
    return body + signs[-sum(signs.index(c) * 3**i for i, c in enumerate(body)) % 31]


def _luhn(body: str) -> str:
    return body + str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body))) % 10)


def _spoilt(value: str) -> str:
    """With another last digit."""
    return value[:-1] + str((int(value[-1]) + 1) % 10 if value[-1].isdigit() else 3)


_IDS = [_id18(f"110105{y}0{m}{d}{s}") for y, m, d, s in ((1949, 3, 12, "002"), (1987, 7, 24, "113"), (2001, 1, 30, "458"))]
_USCCS = [_uscc(b) for b in ("91350100M000100Y4", "91110108MA01ABCD2", "92440300MA5FQ8RT7")]
_CARDS = [_luhn(b) for b in ("622202020011223", "411111111111111", "622848001234567890")]

GROUPS: dict[str, tuple[MaskConfig, list[Case]]] = {
    "credentials": (
        MaskConfig(custom_terms=("Project Heron",)),
        [
            Case("pem", "key: ", "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'MII' || k || chr(10) || '-----END RSA PRIVATE KEY-----'", " end", "pem"),
            Case("jwt", "use ", f"'eyJhbGciOi' || {_padded(4)} || '.eyJzdWIi' || {_padded(6)} || '.c2lnbmF0' || {_padded(5)}", " now", "jwt"),
            Case("openai style", "set ", f"'sk-' || {_padded(20)}", " there", "key"),
            Case("github", "set ", f"'ghp_' || {_padded(24)}", " there", "key"),
            Case("github long", "set ", f"'github_pat_' || {_padded(24)}", " there", "key"),
            Case("cloud", "set ", f"'AKIA' || {_padded(16)}", " there", "key"),
            Case("chat", "set ", f"'xoxb-' || {_padded(14)}", " there", "key"),
            Case("bearer", "Authorization is Bearer ", f"'ab.' || {_padded(20)}", ", ok", "key"),
            Case("basic", "BASIC ", f"'YWxhZGRpbjo' || {_padded(8)}", ", ok", "key"),
            Case("key value", 'password = "', f"'hunter' || {_padded(6)}", '" ok', "key"),
            Case("aws key", "aws_secret_access_key: ", f"'wJal/' || {_padded(10)}", ", ok", "key"),
            Case("mailto", "see ", "'mailto:' || 'a:b' || k || '@example.com'", " or", "email"),
            Case("url user", "get https://bob:", f"'pw' || {_padded(5)}", "@example.com/x", "key"),
            Case("bare user", "ssh bob:", f"'pw' || {_padded(5)}", "@host.example", "key"),
            Case("term", "about ", "'Project Heron'", " today", "custom"),
            Case("short key", "set sk-", "k", " there", None),
            Case("short value", "token = ", "substr(k, 1, 3)", " there", None),
        ],
    ),
    "network": (
        MaskConfig(redact_paths=True),
        [
            Case("email", "to ", "'u.' || k || '@mail.example.org'", ", ok", "email"),
            Case("phone", "call ", f"'+1 (212) 555-' || {_padded(4)}", ", ok", "phone"),
            Case("ipv4", "at ", "'10.' || CAST(CAST(k AS INTEGER) % 256 AS VARCHAR(3)) || '.0.255'", ", ok", "ipv4"),
            Case("ipv6 full", "at ", f"'2001:db8:0:0:1:2:3:' || {_padded(4)}", ", ok", "ipv6"),
            Case("ipv6 short", "at ", f"'fe80:1::' || {_padded(4)}", ", ok", "ipv6"),
            Case("mac", "at ", "'00:1b:44:11:3a:' || lpad(CAST(CAST(k AS INTEGER) % 100 AS VARCHAR(2)), 2, '0')", ", ok", "mac"),
            Case("hex", "sum ", f"'deadbeef' || {_padded(40, 'a')}", ", ok", "hex"),
            Case("b64", "blob ", f"'QUJD/+xyz' || {_padded(30, 'Z')} || '=='", ", ok", "b64"),
            Case("posix path", "in ", "'/home/user' || k || '/notes.txt'", " now", "path"),
            Case("windows path", "in ", "'C:\\Users\\u' || k", " now", "path"),
            Case("octet too large", "at 10.0.0.", "'256'", ", ok", None),
            Case("time", "at ", "'12:30:45'", ", ok", None),
            Case("scope", "in ", "'std::vector'", ", ok", None),
        ],
    ),
    "numbers": (
        MaskConfig(redact_case_numbers=True, redact_dob=True),
        [
            Case("id18", "号码 ", _pick(_IDS), "。", "id18"),
            Case("id18 bad check", "编号 ", _pick([_spoilt(x) for x in _IDS]), "。", None),
            Case("id18 label", "身份证号：", _pick([_spoilt(x) for x in _IDS]), "。", "id18"),
            Case("id15", "身份证号码：", f"'1101054912' || {_padded(5)}", "。", "id15"),
            Case("uscc", "代码 ", _pick(_USCCS), "。", "uscc"),
            Case("uscc label", "统一社会信用代码：", _pick([x[:-1] + "i" for x in _USCCS]), "。", "uscc"),
            Case("mobile", "手机", f"'139' || {_padded(8)}", "。", "mobile"),
            Case("split mobile", "手机", f"'138-0000-' || {_padded(4)}", "。", "mobile"),
            Case("tel", "座机", f"'025-8' || {_padded(7)}", "。", "tel"),
            Case("wechat", "微信：", f"'wx_' || {_padded(5)}", "。", "wechat"),
            Case("qq", "QQ：", f"'1' || {_padded(7)}", "。", "qq"),
            Case("certificate", "执业证号：", f"'L-2020' || {_padded(6)}", "。", "certid"),
            Case("bank label", "账号：", f"'62220' || {_padded(12)}", "。", "bank"),
            Case("bank", "卡 ", _pick(_CARDS), "。", "bank"),
            Case("bank bad check", "卡 ", _pick([_spoilt(x) for x in _CARDS]), "。", None),
            Case("case", "见", f"'（2023）苏0102民初' || {_padded(4)} || '号'", "。", "case"),
            Case("plate", "车牌 ", f"'苏A' || {_padded(5)}", "。", "plate"),
            Case("passport", "护照 ", f"'E' || {_padded(8)}", "。", "passport"),
            Case("birth", "出生日期：", "'1990年' || CAST(CAST(k AS INTEGER) % 9 + 1 AS VARCHAR(1)) || '月3日'", "。", "dob"),
        ],
    ),
    "loose_ids": (
        MaskConfig(strict_id18=False),
        [
            Case("dated", "编号 ", _pick([_spoilt(x) for x in _IDS]), "。", "id18"),
            Case("undated", "编号 ", "'110105199913' || '45' || '0021'", "。", None),
        ],
    ),
    "places": (
        MaskConfig(),
        [
            Case("label", "户籍地址：", "'幸福里' || k || '栋302室'", "。", "addr"),
            Case("residence", "住所：", "'幸福里' || k || '栋302室'", "。", "addr"),
            Case("residence of a region", "住所", "'南京市玄武区珠江里' || k || '栋'", "。", "addr"),
            Case("chain", "他住在", _pick(["江苏省南京市玄武区梅园街道", "浙江省杭州市余杭区良渚镇", "四川省成都市龙泉驿区大面街道"]), "。", "addrchain"),
            Case("road chain", "他住在", _pick(["南京市玄武区珠江路", "杭州市余杭区文一西路"]), "。", "addrchain"),
            Case("street", "到 ", "'中山北路' || k || '号'", "。", "street"),
            Case("any village", "", "'我们村'", "很大。", None),
            Case("idiom", "他", "'走街串巷'", "。", None),
        ],
    ),
    "entities": (
        MaskConfig(preserve_values=("李四光",)),
        [
            Case("person", "原告", _pick(["周明", "吴芳", "郑伟", "欧阳修远"]), "，住本市。", "name"),
            Case("named", "联系人：", _pick(["周明", "吴芳", "郑伟"]), "。", "name"),
            Case("company", "查询", _pick(["杭州云栖网络科技有限公司", "南京金陵饭店集团股份有限公司", "ABC电子有限公司"]), "的信息。", "company"),
            Case("agency", "由", _pick(["青山市公安局河东分局", "江宁市司法局"]), "办理。", "org"),
            Case("court", "此致，", _pick(["南京市玄武区人民法院", "上海市第一中级人民法院"]), "。", None),
            Case("any company", "", "'这家公司'", "很好。", None),
            Case("preserved", "原告", "'李四光'", "，住本市。", None),
        ],
    ),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def planted(spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
    """(key, case_name, text): each case of a group in each row of supplier."""
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").cast("string").alias("k"))
    spoken = lambda e: e.replace("\\", "\\\\")  # noqa: E731  string literals of Spark
    cases = [F.expr(f"struct({_quoted(c.name)} AS case_name, concat({_quoted(c.before)}, {spoken(c.value)}, {_quoted(c.after)}) AS text)") for c in GROUPS[group][1]]
    return keys.select("key", F.explode(F.array(*cases)).alias("x")).select("key", "x.case_name", "x.text")


def masked(group: str):
    """The query of a group: (key, case_name, masked, cats)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = documents.mask_documents(planted(spark, sf_dir, group), cfg=GROUPS[group][0])
        return done.select("key", "case_name", F.col("text").alias("masked"), F.array_join(F.map_keys("mask_counts"), ",").alias("cats"))

    return run


def masked_sql(group: str) -> str:
    rows = []
    for c in GROUPS[group][1]:
        quoted = [x.replace("'", "''") for x in (c.before, c.after, c.name)]
        value = f"'[REDACTED_{c.cat.upper()}_1]'" if c.cat else c.value
        rows.append(f"SELECT key, '{quoted[2]}' AS case_name, '{quoted[0]}' || {value} || '{quoted[1]}' AS masked, '{c.cat or ''}' AS cats FROM keys")
    return "WITH keys AS (SELECT s_suppkey AS key, CAST(s_suppkey AS VARCHAR) AS k FROM supplier) " + " UNION ALL ".join(rows)


QUERIES = {f"rules_{group}": masked(group) for group in GROUPS}
SQL = {f"rules_{group}": masked_sql(group) for group in GROUPS}
