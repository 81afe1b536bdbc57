"""Every alternative of every redaction pattern, redacted with and without the literal screens."""
import itertools

from pyspark.sql import functions as F

from faultlens.functions.redaction import REDACTIONS, marker, redact, residual_hits

A, B = "A1b2C3d4E5f6G7h8I9j0", "abcdefghij0123456789ABCDEFGHIJ987654321"
KEYS = ["", "ENCRYPTED ", "RSA ", "EC ", "OPENSSH ", "DSA ", "PGP "]
SAMPLES = {
    "private_key": [f"-----BEGIN {k}PRIVATE KEY-----\nx\n-----END {k}PRIVATE KEY-----" for k in KEYS],
    "unterminated_private_key": [f"-----BEGIN {k}PRIVATE KEY-----\nx" for k in KEYS],
    "authorization": ["Authorization: Basic x", "AUTHORIZATION=y"],
    "cookie": ["Cookie: a=b", "set-cookie=c"],
    "url_credentials": ["https://user:pw@host/x", "ftp://u:@h"],
    "query_credential": [f"{mark}{name}=v1" for mark, name in itertools.product("?&", [
        "access_token", "access-token", "accesstoken", "api_key", "api-key", "apikey", "auth", "password", "secret", "sig", "signature", "token"])],
    "jwt": ["eyJabcde.fghij.klmno"],
    "bearer": [f"bearer {A}"],
    "aws_key": ["AKIA" + "A1B2C3D4E5F6G7H8", "ASIA" + "A1B2C3D4E5F6G7H8"],
    "aws_secret": [f"{name}{eq}{quote}{B}{quote}" for name, eq, quote in itertools.product(["aws_secret_access_key", "secret_key", "secretkey", "secret_accesskey"], [":", "="], ["", "'", '"'])],
    "azure_sas": ["sv=2020-01-01&x=1&sig=abc"],
    "github_token": [f"gh{c}_{B}" for c in "pousr"] + [f"github_pat_{A}"],
    "gitlab_token": [f"glpat-{A}"], "groq_key": [f"gsk_{A}"], "slack_webhook": ["https://hooks.slack.com/services/T0/B0/x", "HTTPS://HOOKS.SLACK.COM/services/T0"],
    "openai_key": [f"sk-{A}"], "google_key": ["AIza" + "a" * 35], "slack_token": [f"xox{c}-{A}" for c in "baprs"],
    "stripe_key": [f"{k}_{m}_{A}" for k, m in itertools.product(["sk", "rk"], ["live", "test"])],
    "npm_token": [f"npm_{B}"], "pypi_token": [f"pypi-{A}"], "vault_token": [f"hvs.{A}"],
    "password": [f"{name}{eq}{value}" for name, eq, value in itertools.product(
        ["client_secret", "access-token", "refreshtoken", "id_token", "password", "passwd", "pwd", "secret", "token", "api_key", "credential", "auth", "db_password", '"password"'], [":", " = "], ["v", "'v w'", '"v w"'])],
    "connection_string": [f"{name}://h/db" for name in ["postgres", "postgresql", "mysql", "mongodb", "redis", "amqp", "smtp", "mssql"]],
    "email": ["a.b+c@example.org"],
    "ipv6_address": ["2001:db8::1", "1:2:3:4:5:6:7:8", "::1", "fe80::", "1:2:3:4:5:6:10.0.0.1", "::ffff:10.0.0.1", "1::8", "fe80::1%eth0"],
    "ip_address": ["10.20.30.40"],
}


def test_screened_equals_unscreened(spark):
    assert list(SAMPLES) == [kind for kind, _ in REDACTIONS]
    rows = [(kind, f"{before}{text}{after}") for kind, texts in SAMPLES.items() for text in texts for before, after in (("", ""), ("found ", " in step"))]
    plain = F.col("text")
    for kind, pattern in REDACTIONS:
        plain = F.regexp_replace(plain, pattern, marker(kind))
    df = spark.createDataFrame(rows, "kind string, text string").repartition(4)
    # One statement for each: the two chains together are one very large expression.
    got = {(r.kind, r.text): r.done for r in df.select("kind", "text", redact("text").alias("done")).collect()}
    want = {(r.kind, r.text): r.done for r in df.select("kind", "text", plain.alias("done")).collect()}
    assert got == want
    for (kind, text), done in got.items():
        assert "[REDACTED:" in done, (kind, text)
    left = df.select(residual_hits("text").alias("n")).where("n = 0").count()
    assert left == 0
