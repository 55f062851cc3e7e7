"""Privacy classification of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import all_blanks, ascii_boundaries

# Signal patterns, in the order of their evaluation.
SIGNALS = (
    ("secrets_or_credentials", "bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}"),
    ("secrets_or_credentials", "token_prefix", r"(?i)\b(?:sk|ghp|gho|github_pat|xox[baprs])[-_][A-Za-z0-9_-]{16,}"),
    ("secrets_or_credentials", "aws_access_key", r"\bAKIA[A-Z0-9]{16}\b"),
    ("secrets_or_credentials", "jwt_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("secrets_or_credentials", "private_key_block", r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("secrets_or_credentials", "credential_assignment", r"""(?i)\b(?:api[\s_-]?key|client[\s_-]?secret|db[\s_-]?password|secret|password|passwd|token|access[\s_-]?token|refresh[\s_-]?token)["']?\s*[:=]\s*["']?[^\s,"'}]{1,}"""),
    ("health_genetics", "nhs_identifier", r"(?i)\bnhs\s*(?:number|no\.?|id)\s*[:=]?\s*\d[\d ]{8,12}\b"),
    ("health_genetics", "medical_identifier", r"(?i)\b(?:patient|medical)\s*(?:id|record|number|file)\s*[:=]\s*[A-Za-z0-9-]{5,}\b"),
    ("health_genetics", "date_of_birth", r"(?i)\b(?:date of birth|dob)\s*[:=]\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("client_sensitive", "client_confidentiality_marker", r"(?i)\b(client confidential|customer data|nda|commercially sensitive)\b"),
    ("client_sensitive", "customer_system_record", r"(?i)\b(stripe customer|hubspot contact|salesforce account)\b"),
    ("personal_sensitive", "email_address", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("personal_sensitive", "uk_mobile_number", r"(?i)\b(\+44|0)7\d{9}\b"),
    ("personal_sensitive", "personal_identifier", r"(?i)\b(?:home address|passport|driving licence|national insurance)\s*[:=]\s*[^\n]{5,}"),
    ("personal_sensitive", "uk_postcode", r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"),
    ("local_private", "private_env_origin", r"(?i)(?:^|[/\\])\.env(?:\.|\z)"),
    ("local_private", "private_workspace_origin", r"(?i)(?:/Users/[^/]+/Documents/Obsidian|/home/[^/]+/Documents/Obsidian|[A-Za-z]:[\\/]+Users[\\/]+[^\\/]+[\\/]+Documents[\\/]+Obsidian|/private-workspace-state(?:/|\z))"),
    ("local_private", "private_client_origin", r"(?i)(?:client|customer)[-_ ]?(?:private|confidential)"),
    ("non_sensitive_bulk", "credential_discussion", r"(?i)\b(api[\s_-]?keys?|secrets?|passwords?|private[\s_-]?keys?|access[\s_-]?tokens?)\b"),
    ("non_sensitive_bulk", "health_topic_discussion", r"(?i)\b(genetic|genome|dna|biopsy|diagnosis|prescription|medical cannabis)\b"),
)
# Words of which a text must hold one, in lower case, for the signal to be possible.
NEEDLES = {
    "bearer_token": ("bearer",),
    "token_prefix": ("sk-", "sk_", "ghp", "gho", "github_pat", "xox"),
    "aws_access_key": ("akia",),
    "jwt_token": ("eyj",),
    "private_key_block": ("-----begin ",),
    "credential_assignment": ("key", "secret", "password", "passwd", "token"),
    "nhs_identifier": ("nhs",),
    "medical_identifier": ("patient", "medical"),
    "date_of_birth": ("date of birth", "dob"),
    "client_confidentiality_marker": ("client confidential", "customer data", "nda", "commercially sensitive"),
    "customer_system_record": ("stripe customer", "hubspot contact", "salesforce account"),
    "email_address": ("@",),
    "uk_mobile_number": ("07", "+447"),
    "personal_identifier": ("home address", "passport", "driving licence", "national insurance"),
    "private_env_origin": (".env",),
    "private_workspace_origin": ("obsidian", "private-workspace-state"),
    "private_client_origin": ("private", "confidential"),
    "credential_discussion": ("key", "secret", "password", "token"),
    "health_topic_discussion": ("genetic", "genome", "dna", "biopsy", "diagnosis", "prescription", "medical cannabis"),
}
#: Simpler patterns that a text must match for the signal to be possible.
GUARDS = {"uk_postcode": "[0-9][A-Za-z]{2}"}
# The signal of long runs, the order of classes, and keys of digests.
ENTROPY_SIGNAL = ("secrets_or_credentials", "high_entropy_credential_candidate")
CLASS_RANK = {"non_sensitive_bulk": 0, "local_private": 1, "personal_sensitive": 2, "client_sensitive": 3, "health_genetics": 4, "secrets_or_credentials": 5}
DIGEST_KEYS = ("glossary_sha256", "input_sha256", "network_payload_sha256", "output_sha256", "payload_sha256", "shard_sha256", "source_sha256", "target_sha256")

_ANY_RUN = r"[A-Za-z0-9_+/=-]{24}"
_RUN = r"[A-Za-z0-9_+/=-]{24,200}"


def entropy(run: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(run, "")
    n = F.length(run).cast("double")
    count = lambda c: (n - F.length(F.replace(run, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - count(c) * F.log2(count(c)))


def high_entropy_runs(text: Column) -> Column:
    """Runs of 24 to 200 key characters (a longer one is cut into several) with a letter, a digit, ten distinct characters and 3.5 bits."""
    runs = F.when(text.rlike(_ANY_RUN), F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.filter(runs, lambda r: r.rlike("[A-Za-z]") & r.rlike("[0-9]") & (F.size(F.array_distinct(F.split(r, ""))) >= 10) & (entropy(r) >= 3.5))


def findings(text: Column) -> Column:
    """``category, signal, severity`` of each signal that the text shows, once, in order."""
    item = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("signal"), F.lit("warning" if c == "non_sensitive_bulk" else "blocker").alias("severity"))

    def shows(signal: str, pattern: str, low: Column) -> Column:
        """A search for fixed words is many times faster than the pattern, and settles most texts."""
        found = text.rlike(all_blanks(ascii_boundaries(pattern)))
        found = text.rlike(GUARDS[signal]) & found if signal in GUARDS else found
        possible = F.lit(False)
        for needle in NEEDLES.get(signal, ()):
            possible = possible | F.contains(low, F.lit(needle))
        return possible & found if signal in NEEDLES else found

    def hits(low: Column) -> Column:
        return F.array_compact(F.array(*(F.when(shows(s, p, low), item(c, s)) for c, s, p in SIGNALS), F.when(F.size(high_entropy_runs(text)) > 0, item(*ENTROPY_SIGNAL))))

    # A one-element array binds the lower-case text, which would be made anew for each word.
    return F.get(F.transform(F.array(F.lower(text)), hits), F.lit(0))


def classify(items: DataFrame, text: Column, *keys: str) -> DataFrame:
    """One row for each item and finding."""
    return items.select(*keys, F.inline(findings(text)))


def privacy_class(found: Column) -> Column:
    """The highest class among blockers of an array of findings."""
    rank = F.array_max(F.transform(F.filter(found, lambda f: f["severity"] == "blocker"), lambda f: F.element_at(F.create_map(*(F.lit(x) for kv in CLASS_RANK.items() for x in kv)), f["category"])))
    return F.element_at(F.array(*(F.lit(k) for k in CLASS_RANK)), F.coalesce(rank, F.lit(0)) + 1)


def mask_digests(metadata_json: Column) -> Column:
    """JSON text in which values of provenance keys (in any case, at any depth) that are exactly 64 hex digits read ``[digest]``."""
    keys = "|".join(DIGEST_KEYS)
    return F.regexp_replace(metadata_json, rf'(?i)((?<!\\)"(?:{keys})"\s*:\s*)"[a-f0-9]{{64}}"', '$1"[digest]"')


def outbound_report(payload_json: Column) -> Column:
    """``recommended_egress_class, external_allowed, findings`` of what would be sent; a null payload is ``null``."""
    both = lambda f: F.struct(privacy_class(f).alias("recommended_egress_class"), (F.size(F.filter(f, lambda x: x["severity"] == "blocker")) == 0).alias("external_allowed"), f.alias("findings"))
    # A one-element array binds the findings, so that all values come from one evaluation.
    return F.get(F.transform(F.array(findings(F.coalesce(payload_json, F.lit("null")))), both), F.lit(0))


def item_text(prompt: Column, messages: Column, metadata: Column) -> Column:
    """Prompt, message contents and metadata by line feeds; empty parts are left out."""
    parts = F.concat(F.array(prompt), F.coalesce(F.transform(messages, lambda m: m["content"]), F.array().cast("array<string>")), F.array(F.when(F.size(metadata) > 0, mask_digests(F.to_json(metadata)))))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")
