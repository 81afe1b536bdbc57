"""Secret and personal-data redaction as ordered regular expressions."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from faultlens.functions.text import as_col, let

_KEY_NAME = r"(?:ENCRYPTED |RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"
KEY_BEGIN = "-----BEGIN " + _KEY_NAME
KEY_END = "-----END " + _KEY_NAME


def _ipv6_address() -> str:
    """Grammar of a valid IPv6 address, built from the number of groups before and after ``::``."""
    h = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    tail = f"(?:{h}:{h}|{octet}(?:\\.{octet}){{3}})"
    forms = [f"(?:{h}:){{6}}{tail}"]
    for after in range(5, -1, -1):
        before = 5 - after
        lead = f"(?:(?:{h}:){{0,{before - 1}}}{h})?" if before else ""
        forms.append(f"{lead}::(?:{h}:){{{after}}}{tail}")
    forms.append(f"(?:(?:{h}:){{0,5}}{h})?::{h}")
    forms.append(f"(?:(?:{h}:){{0,6}}{h})?::")
    return "(?:" + "|".join(forms) + ")"


# Ordered (kind, pattern); token shapes precede the generic address fallbacks.
REDACTIONS: list[tuple[str, str]] = [
    ("private_key", "(?s)" + KEY_BEGIN + ".*?" + KEY_END),
    ("unterminated_private_key", KEY_BEGIN + r"[\s\S]*\z"),
    ("authorization", r"(?i)\bAuthorization\s*[:=]\s*[^\r\n,}]+"),
    ("cookie", r"(?i)\b(?:Set-Cookie|Cookie)\s*[:=]\s*[^\r\n,}]+"),
    ("url_credentials", r"(?i)\b[A-Za-z][A-Za-z0-9+.-]*://[^\s/@?#:]+:[^\s/@?#]*@"),
    ("query_credential",
     r"(?i)[?&](?:access[_-]?token|api[_-]?key|auth|password|secret|sig(?:nature)?|token)=[^&#\s]+"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    ("bearer", r"(?i)\bBearer [A-Za-z0-9._~+/=-]{16,}"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("aws_secret",
     r"(?i)\b(?:aws_)?secret(?:_access)?_?key\s*[:=]\s*"
     r"(?:\"[A-Za-z0-9/+=]{32,}\"|'[A-Za-z0-9/+=]{32,}'|[A-Za-z0-9/+=]{32,}\b)"),
    ("azure_sas", r"(?i)\bsv=\d{4}-\d{2}-\d{2}[&A-Za-z0-9%._~=/+-]*\bsig=[^\s\"']+"),
    ("github_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,})\b"),
    ("gitlab_token", r"\bglpat-[A-Za-z0-9_-]{20,}\b"),
    ("groq_key", r"\bgsk_[A-Za-z0-9_-]{20,}\b"),
    ("slack_webhook", r"(?i)https://hooks\.slack\.com/services/[A-Za-z0-9/_-]+"),
    ("openai_key", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("google_key", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("stripe_key", r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{20,}\b"),
    ("npm_token", r"\bnpm_[A-Za-z0-9]{36,}\b"),
    ("pypi_token", r"\bpypi-[A-Za-z0-9_-]{20,}\b"),
    ("vault_token", r"\bhvs\.[A-Za-z0-9_-]{20,}\b"),
    ("password",
     r"(?i)(?<![A-Za-z0-9_])[\"']?(?:[A-Za-z0-9]+[_-])*"
     r"(?:(?:client|access|refresh|id)[_-]?(?:secret|token)|password|passwd|pwd|secret|token|api[_-]?key|credential|"
     r"auth)[\"']?\s*[:=]\s*(?:\"[^\"\r\n]*\"|'[^'\r\n]*'|[^\s\"']+)"),
    ("connection_string",
     r"(?i)\b(?:postgres|postgresql|mysql|mongodb|redis|amqp|smtp|mssql)://[^\s\"']+"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("ipv6_address",
     r"(?U)(?<![\w:])" + _ipv6_address() + r"(?:%[0-9A-Za-z_.-]*[0-9A-Za-z_-])?(?!\.*[0-9A-Fa-f:%])(?![\w:])"),
    ("ip_address", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
]

# Literals of which a text must hold one for the pattern to match at all. Looking for them costs a byte scan, so most
# patterns never start on text without secrets. Patterns that ignore case are screened by words of the lower-cased text too.
_SCREENS: dict[str, tuple[str, ...]] = {
    "private_key": ("-----BEGIN ",), "unterminated_private_key": ("-----BEGIN ",), "url_credentials": ("://",), "jwt": ("eyJ",), "aws_key": ("AKIA", "ASIA"),
    "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "gitlab_token": ("glpat-",), "groq_key": ("gsk_",),
    "slack_webhook": ("://",), "openai_key": ("sk-",), "google_key": ("AIza",), "slack_token": ("xox",), "stripe_key": ("k_",),
    "npm_token": ("npm_",), "pypi_token": ("pypi-",), "vault_token": ("hvs.",), "password": (":", "="),
    "connection_string": ("://",), "email": ("@",), "ip_address": (".",),
}
_LOW_SCREENS: dict[str, tuple[str, ...]] = {
    "authorization": ("authorization",), "cookie": ("cookie",), "query_credential": ("token=", "key=", "auth=", "password=", "secret=", "sig=", "signature="),
    "bearer": ("bearer ",), "aws_secret": ("secret",), "azure_sas": ("sig=",),
    "password": ("secret", "token", "password", "passwd", "pwd", "key", "credential", "auth"),
}
# Tried in place of a pattern, with the same matches: a run of local characters is tried from its beginning alone (or from the end of the
# match before it), not from each of its characters.
_FASTER = {"email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}
# What leads to the ``::`` of an address begins the text or follows what is no word.
_IPV6_NEAR = r"::(?<=(?:\A|[^0-9A-Za-z_:])[0-9A-Fa-f:.]{0,40}::)"


def _may_match(kind: str, text: Column) -> Column:
    if kind == "ipv6_address":
        # Without ``::`` an address has at least six colons in a row of groups.
        return (text.contains("::") & text.rlike(_IPV6_NEAR)) | text.rlike(":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:")
    holds = lambda text, words: reduce(or_, [text.contains(word) for word in words])
    result = holds(text, _SCREENS[kind]) if kind in _SCREENS else F.lit(True)
    return result & let(F.lower(text), lambda low: holds(low, _LOW_SCREENS[kind])) if kind in _LOW_SCREENS else result


# Fixed value: field names whose whole value is secret.
SENSITIVE_KEY = (
    r"(?i)(?:^|[_\W])(?:password|passwd|pwd|secret|token|api[_-]?key|credential|authorization|cookie|"
    r"private[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|webhook|signature|sig)(?:$|[_\W])"
)
MAX_DEPTH = 16


def marker(kind: str) -> str:
    return f"[REDACTED:{kind}]"


def redact(text: Column | str) -> Column:
    """Every sensitive shape replaced by its marker, one pass per kind in fixed order."""
    def pass_of(kind: str, pattern: str):
        return lambda s: F.when(_may_match(kind, s), F.regexp_replace(s, pattern, marker(kind))).otherwise(s)

    result = as_col(text)
    for kind, pattern in REDACTIONS:
        result = let(result, pass_of(kind, _FASTER.get(kind, pattern)))
    return result


def redact_counted(text: Column | str) -> Column:
    """``struct<text, hits array<int>>``: hits per kind, each counted on the text its pattern sees."""
    def pass_of(kind: str, pattern: str):
        def step(s: Column) -> Column:
            count = F.when(_may_match(kind, s["text"]), F.regexp_count(s["text"], F.lit(pattern))).otherwise(0)
            return let(
                F.struct(s["text"].alias("text"), s["hits"].alias("hits"), count.alias("n")),
                lambda t: F.struct(
                    F.when(t["n"] > 0, F.regexp_replace(t["text"], pattern, marker(kind))).otherwise(t["text"]).alias("text"),
                    F.array_append(t["hits"], t["n"]).alias("hits"),
                ),
            )

        return step

    state = F.struct(as_col(text).alias("text"), F.array().cast("array<int>").alias("hits"))
    for kind, pattern in REDACTIONS:
        state = let(state, pass_of(kind, _FASTER.get(kind, pattern)))
    return state


def hit_total(counted: Column) -> Column:
    return F.aggregate(counted["hits"], F.lit(0), lambda total, n: total + n)


def residual_hits(text: Column | str) -> Column:
    """Sensitive matches left in already sanitized text."""
    return hit_total(redact_counted(text))


def sensitive_key(name: Column) -> Column:
    """Whether a snake, kebab, dotted or camel-case field name holds a credential."""
    return F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_").rlike(SENSITIVE_KEY)
