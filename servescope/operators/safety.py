"""Content safety over whole texts: named findings, encoded payloads, markers, URLs, binaries.

Every pattern is checked with the regex engine of the JVM; a plain substring test in front of it
(a literal each match must contain) keeps the regex off texts that cannot match.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_USER = "[A-Za-z0-9][A-Za-z0-9._-]{0,63}"
_HOST = "[A-Za-z0-9][A-Za-z0-9._-]{0,252}"
_CREDENTIALS = (
    "aws_secret_access_key", "api_key", "client_secret", "proxy_password", "access_token",
    "refresh_token", "HF_TOKEN", "HUGGING_FACE_HUB_TOKEN", "HUGGINGFACE_HUB_TOKEN",
    "HUGGINGFACEHUB_API_TOKEN",
)

# Rule name, pattern, and lower-case literals of which every match contains one.
# What stands before a match is consumed (no look-behind), which changes no verdict.
SECRET_RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "private-key-header": ("(?i)-----BEGIN PRIVATE KEY-----", ("-----begin private key-----",)),
    "submitted-project-file": ("(?i)personal-notes\\.md", ("personal-notes.md",)),
    "internal-ledger-file": ("(?i)private-ledger", ("private-ledger",)),
    "private-credit-plan": ("(?i)lender-file", ("lender-file",)),
    "private-migration-source": ("(?i)identity-doc", ("identity-doc",)),
    "canonical-private-project": ("(?i)private project-file", ("private project-file",)),
    "sensitive-health-file": ("(?i)medical-record", ("medical-record",)),
    "sensitive-relative-file": ("(?i)family-record", ("family-record",)),
    "sensitive-monetary-file": ("(?i)finance-record", ("finance-record",)),
    "sensitive-credit-file": ("(?i)loan-application", ("loan-application",)),
    "sensitive-cv-file": ("(?i)notes_private", ("notes_private",)),
    "apple-user-home-path": (
        f"(?i)(?:^|[^A-Za-z0-9._:/\\\\-])/Users/{_USER}(?:[^A-Za-z0-9._-]|$)", ("/users/",)),
    "linux-user-home-path": (
        f"(?i)(?:^|[^A-Za-z0-9._-])/home/{_USER}(?:[^A-Za-z0-9._-]|$)", ("/home/",)),
    "windows-user-home-path": (
        f"(?i)(?:^|[^A-Za-z0-9._-])[A-Za-z]:[\\\\/](?:Users|Documents and Settings)[\\\\/]{_USER}(?:[^A-Za-z0-9._-]|$)",
        ("users", "documents and settings")),
    "windows-unc-user-home-path": (
        f"(?i)(?:^|[^\\\\])\\\\\\\\{_HOST}[\\\\/](?:Users[\\\\/])?{_USER}(?:[^A-Za-z0-9._-]|$)", ("\\\\",)),
    "aws-access-key": ("\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b", ("akia", "asia")),
    "github-token": ("\\bgh[pousr]_[A-Za-z0-9]{30,}\\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    "generic-api-token": ("\\bsk-[A-Za-z0-9_-]{20,}\\b", ("sk-",)),
    "hugging-face-token": ("\\bhf_[A-Za-z0-9]{20,}\\b", ("hf_",)),
    "credential-file-content": (
        f"(?im)(?:^|[\"'])(?:{'|'.join(_CREDENTIALS)})[\"']?\\s*(?:=|:)\\s*[\"']?\\S+",
        tuple(c.lower() for c in _CREDENTIALS)),
    "authorization-header": (
        "(?im)(?:^|[,{])\\s*[\"']?(?:proxy-)?authorization[\"']?\\s*:\\s*[\"']?\\S+", ("authorization",)),
    "cookie-header": (
        "(?im)(?:^|[,{])\\s*[\"']?(?:cookie|set-cookie)[\"']?\\s*:\\s*[\"']?\\S+", ("cookie",)),
    "proxy-credential-url": ("(?i)\\bhttps?://[^\\s/:@]+:[^\\s/@]+@[^\\s/]+", ("http://", "https://")),
    "gpu-uuid": (
        "(?i)\\bGPU-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b", ("gpu-",)),
    "model-cache-path": (
        "(?i)(?:^|[\\s=:\"'])(?:~|/[^\\s\"']+)?/\\.cache/(?:huggingface|torch|vllm)(?:/|\\b)", ("/.cache/",)),
    "notebook-account-identifier": (
        "(?i)\\b(?:kaggle\\.com/code/[^\\s/]+/[^\\s]+|colab\\.research\\.google\\.com/drive/[^\\s/?#]+)",
        ("kaggle.com/code/", "colab.research.google.com/drive/")),
    "private-hostname-suffix": (
        "(?i)\\b[A-Za-z0-9][A-Za-z0-9.-]*\\.(?:corp|internal|lan|local)\\b",
        (".corp", ".internal", ".lan", ".local")),
    "private-account-identifier": (
        "(?i)\\b(?:account|notebook)[_-]?id\\s*(?:=|:)\\s*[\"']?\\S+", ("account", "notebook")),
    "internal-control-plane-file": (
        "(?i)orgname[^\\n]{0,80}(?:claim|ledger|control[-_ ]?plane)", ("orgname",)),
}

# Values that mark evidence as synthetic, and suffixes of generated binaries.
SYNTHETIC_MARKERS = (
    "test_fixture_only", "synthetic_protocol_shape_only", "synthetic_future_shape_only",
    "synthetic-future-shape", "synthetic-shape", "<fixture-", "stage2-fixture",
)
GENERATED_SUFFIXES = (
    ".bin", ".ckpt", ".npy", ".npz", ".nsys-rep", ".onnx", ".pt", ".qdrep", ".safetensors",
)
URL = "(?i)https?://[^\\s\"']+"
LOOPBACK = "http://127.0.0.1"


def literal_rule(value: str) -> tuple[str, tuple[str, ...]]:
    """A host-specific word (own home folder, own host name) as a bounded rule."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in value)
    return f"(?i)(?:^|[^A-Za-z0-9._-]){quoted}(?:[^A-Za-z0-9._-]|$)", (value.lower(),)


def _hit(text: Column, lowered: Column, rule: tuple[str, tuple[str, ...]]) -> Column:
    pattern, needles = rule
    possible = F.lit(False)
    for needle in needles:
        possible = possible | F.contains(lowered, F.lit(needle))
    # only a line feed ends a line
    return possible & text.rlike(f"(?d){pattern}")


def scan_secrets(
    files: DataFrame,
    keys: Sequence[str] = ("path",),
    text: str = "content",
    extra: Mapping[str, tuple[str, tuple[str, ...]]] | None = None,
) -> DataFrame:
    """(file, rule) for every rule the whole text breaks; one narrow pass, no shuffle."""
    rules = {**SECRET_RULES, **(extra or {})}
    lowered = files.withColumn("__lower", F.lower(text))
    found = F.filter(
        F.array(*[
            F.when(_hit(F.col(text), F.col("__lower"), rule), F.lit(name)) for name, rule in rules.items()
        ]),
        lambda x: x.isNotNull(),
    )
    return lowered.select(*keys, F.explode(found).alias("rule"))


ENCODED = '"[^"]*_base64"\\s*:\\s*"([A-Za-z0-9+/=]*)"'


def decoded_payloads(files: DataFrame, keys: Sequence[str] = ("path",), text: str = "content") -> DataFrame:
    """UTF-8 views of canonical ``*_base64`` string fields at any depth, JSON or JSON lines."""
    each = files.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(ENCODED), F.lit(1))).alias("__b"))
    raw = F.try_to_binary("__b", F.lit("base64"))
    again = F.regexp_replace(F.base64(raw), "[\r\n]", "")
    return each.where(raw.isNotNull() & (again == F.col("__b"))).select(
        *keys, F.make_valid_utf8(raw.cast("string")).alias("decoded")
    )


def scan_encoded(files: DataFrame, keys: Sequence[str] = ("path",), text: str = "content") -> DataFrame:
    return scan_secrets(decoded_payloads(files, keys, text), keys, "decoded").distinct()


def marker_contamination(files: DataFrame, keys: Sequence[str] = ("path",), text: str = "content") -> DataFrame:
    """Live evidence whose string values (field names do not count) carry a synthetic marker."""
    values = F.lower(F.regexp_replace(text, '"(?:\\\\.|[^"\\\\])*"\\s*:', ""))
    found = F.filter(
        F.array(*[F.when(F.contains(values, F.lit(m)), F.lit(m)) for m in SYNTHETIC_MARKERS]),
        lambda x: x.isNotNull(),
    )
    return files.where("scope = 'LIVE'").select(*keys, F.explode(found).alias("marker"))


def remote_urls(files: DataFrame, keys: Sequence[str] = ("path",), text: str = "content") -> DataFrame:
    """Files with a URL that does not point to the loopback address, and the first such URL."""
    urls = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    remote = F.filter(urls, lambda u: ~F.startswith(u, F.lit(LOOPBACK)))
    return files.select(*keys, remote.alias("__r")).where(F.size("__r") > 0).select(
        *keys, F.size("__r").cast("long").alias("remote_urls"), F.get("__r", F.lit(0)).alias("first_url")
    )


def non_text_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Generated binaries by suffix, and content that is not UTF-8."""
    suffix = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))
    reason = F.when(suffix.isin(*GENERATED_SUFFIXES), "generated-binary-or-profiler-artifact").when(
        ~F.is_valid_utf8(F.col(content).cast("string")), "unreviewed-binary-content"
    )
    return files.select("path", reason.alias("rule")).where("rule IS NOT NULL")
