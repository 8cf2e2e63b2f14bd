"""Extraction and validation of indicators, artifacts and threat terms."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import refang, sorted_set, strip, trim_trailing

# The patterns of what is searched for, as the result must equal theirs.
CVE = r"(?i)CVE-\d{4}-\d{4,7}\b"
ATTACK = r"(?i)\bT\d{4}(?:\.\d{3})?\b"
SHA256 = r"\b[a-fA-F0-9]{64}\b"
SHA1 = r"\b[a-fA-F0-9]{40}\b"
MD5 = r"\b[a-fA-F0-9]{32}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = (
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|"
    r"\b(?:[0-9a-fA-F]{1,4}:)*:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*\b"
)
URL = r"(?i)(?:https?|hxxps?|ftp)://[^\s<>'\"`]+"
DOMAIN = (
    r"(?i)\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?:\[\.\]|\(\.\)|\.))+"
    r"(?:com|net|org|edu|gov|mil|io|xyz|ru|cn|info|biz|top|cc|me|tk|in|uk|de)\b"
)
ARTIFACTS = {
    "emails": r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\b",
    "btc_wallets": r"\b(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25,39}\b",
    "eth_wallets": r"\b0x[a-fA-F0-9]{40}\b",
    "xmr_wallets": r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b",
    "registry_keys": r"(?i)\b(?:HKLM|HKCU|HKCR|HKU|HKCC)\\[A-Za-z0-9_\\]+\b",
    "windows_paths": r"\b[a-zA-Z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]+\b",
    "aws_keys": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
}
ACTORS = (
    r"(?i)\b(?:APT\s*[-_]?\d+|FIN\s*[-_]?\d+|TA\s*[-_]?\d+|UNC\s*[-_]?\d+|"
    r"Lazarus(?:\s+Group)?|Volt\s+Typhoon|Salt\s+Typhoon|Sandworm|Cozy\s+Bear|Fancy\s+Bear|"
    r"LockBit(?:\s*\d+\.\d+)?|BlackCat|ALPHV|Cl0p|Scattered\s+Spider|Midnight\s+Blizzard|"
    r"DarkSide|REvil|Conti|Wizard\s+Spider|MuddyWater|Phobos|Hive|Makop|Ragnar\s*Locker|Djvu(?:\/Stop)?)\b"
)
SYSTEMS = (
    r"(?i)\b(?:Windows\s+Server(?:\s+\d{4})?|Windows\s+\d{1,2}|Linux\s+Kernel|Ubuntu|RHEL|Debian|"
    r"CentOS|macOS|iOS|Android|VMware\s+ESXi|Apache\s+(?:HTTP\s+Server|Tomcat|Struts)|"
    r"Nginx|Microsoft\s+Exchange(?:\s+Server)?|Active\s+Directory|OpenSSL|FortiOS|Palo\s+Alto\s+PAN-OS|"
    r"Cisco\s+IOS(?:\s+XE)?|Ivanti\s+(?:Connect\s+Secure|EPMM)|Confluence|Jira|SolarWinds|"
    r"Citrix(?:\s+(?:Application\s+Delivery\s+Controller|ADC|Gateway|NetScaler))?|"
    r"Zoho(?:\s+ManageEngine(?:\s+ADSelfService\s+Plus)?)?)\b"
)
SEVERITY = r"(?i)\b(CRITICAL|HIGH|MEDIUM|LOW|INFORMATIONAL)\b"
SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL")
CVSS = (
    r"(?i)(?:CVSS(?:\s*v?\d(?:\.\d)?)?(?:\s*Base\s*Score)?|Base\s*Score|CVSS\s*Score)"
    r"[*_]*[:\s=]+[*_]*\s*([0-9]\.[0-9]|10\.0)\b|"
    r"\b(?:cvss\s+(?:v\d\s+)?score\s+of\s+)([0-9]\.[0-9]|10\.0)\b"
)
TIMELINE = (
    r"(?i)\b\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?\b|"
    r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|"
    r"Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b"
)
LOCKED_FACTS = (
    r"(?i)\b\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:\s+[a-zA-Z]+)?\s+"
    r"(?:servers|hosts|endpoints|machines|nodes|hours|days|weeks|percent|%)\b"
)
IGNORED_DOMAINS = (
    "github.com", "schemas.openxmlformats.org", "w3.org", "microsoft.com", "google.com", "python.org", "pypi.org",
    "cert-in.org.in", "csk.gov.in", "nomoreransom.org", "docs.microsoft.com",
)
OCTETS = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"

#: The kinds of indicators in the order in which they are reported.
KINDS = (
    "cves", "ipv4_addresses", "ipv6_addresses", "sha256_hashes", "sha1_hashes", "md5_hashes", "domains", "urls", "mitre_attack_ids",
)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def valid_ipv4(c: Column) -> Column:
    """A strict dotted quad that isn't unspecified, broadcast or loopback."""
    return c.rlike(OCTETS) & ~c.isin("0.0.0.0", "255.255.255.255") & ~c.startswith("127.")


def valid_ipv6(c: Column) -> Column:
    """Eight groups, or one ``::`` with at most seven groups."""
    groups = F.size(F.filter(F.split(c, ":"), lambda g: g != ""))
    full = (groups == 8) & ~c.contains("::")
    short = c.contains("::") & ~c.rlike("::.*::|:::") & (groups <= 7) & ~c.rlike("^:[^:]|[^:]:$")
    return full | short


def _wanted_url(ignored: tuple[str, ...], u: Column) -> Column:
    out = F.length(u) > 10
    for d in ignored:
        out = out & ~F.contains(F.lower(u), F.lit(d))
    return out


def _wanted_domain(ignored: tuple[str, ...], x: Column) -> Column:
    out = ~x.endswith(".local")
    for d in ignored:
        out = out & (x != d) & ~x.endswith("." + d)
    return out


def _inside(longer: Column, h: Column) -> Column:
    return F.exists(longer, lambda s: F.contains(s, h))


def with_indicators(df: DataFrame, text: str, ignored: tuple[str, ...] = IGNORED_DOMAINS) -> DataFrame:
    """``df`` with a sorted distinct array of indicators per kind (``KINDS``); columns of these names are replaced.

    Expressions only, in the row: nothing is shuffled or sent to Python. A SHA-1 inside a SHA-256, and an
    MD5 inside either, are left out; URLs that mention an ignored domain and domains below one are too. The
    arrays are columns, not fields of a struct: the optimizer would write a struct's fields out again at
    every use, and each use would search the text anew.
    """
    t = F.col(text)
    lowered = lambda p: F.array_distinct(F.transform(found(t, p), F.lower))
    return (
        df.withColumns({"__256": lowered(SHA256), "__1": lowered(SHA1), "__5": lowered(MD5)})
        .withColumn("__1", F.filter("__1", lambda h: ~_inside(F.col("__256"), h)))
        .withColumn("__5", F.filter("__5", lambda h: ~_inside(F.col("__256"), h) & ~_inside(F.col("__1"), h)))
        .withColumns(
            {
                "cves": sorted_set(F.transform(found(t, CVE), F.upper)),
                "ipv4_addresses": sorted_set(F.filter(found(t, IPV4), valid_ipv4)),
                "ipv6_addresses": sorted_set(F.filter(found(t, IPV6), valid_ipv6)),
                "sha256_hashes": F.array_sort("__256"),
                "sha1_hashes": F.array_sort("__1"),
                "md5_hashes": F.array_sort("__5"),
                "domains": sorted_set(F.filter(F.transform(found(t, DOMAIN), lambda d: F.lower(trim_trailing(refang(d)))), partial(_wanted_domain, ignored))),
                "urls": sorted_set(F.filter(F.transform(found(t, URL), lambda u: trim_trailing(refang(u))), partial(_wanted_url, ignored))),
                "mitre_attack_ids": sorted_set(F.transform(found(t, ATTACK), F.upper)),
            }
        )
        .drop("__256", "__1", "__5")
    )


def columns(names: tuple[str, ...]) -> dict[str, Column]:
    """The named columns by name, as the functions over indicators and terms take them."""
    return {n: F.col(n) for n in names}


def total_found(iocs: dict[str, Column]) -> Column:
    """The number of indicators of all kinds."""
    out = F.lit(0)
    for k in KINDS:
        out = out + F.size(iocs[k])
    return out


def scene_indicators(iocs: dict[str, Column]) -> Column:
    """The kinds that scenes report, together, sorted and distinct."""
    return sorted_set(F.concat(iocs["cves"], iocs["ipv4_addresses"], iocs["sha256_hashes"], iocs["domains"]))


def _named(kind: str, v: Column) -> Column:
    return F.struct(F.lit(kind).alias("ioc_type"), v.alias("value"))


def indicators_long(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per indicator: the keys, ``ioc_type`` and ``value``."""
    rows = with_indicators(df.select(*keys, text), text)
    each = F.flatten(F.array(*[F.transform(k, partial(_named, k)) for k in KINDS]))
    return rows.select(*keys, F.inline(each))


def forensic_artifacts(text: Column) -> Column:
    """Mail addresses, wallets, registry keys, paths and cloud keys: ``map<string,array<string>>``."""
    return F.create_map(*[x for name, p in ARTIFACTS.items() for x in (F.lit(name), sorted_set(found(text, p)))])


def _terms(text: Column, pattern: str) -> Column:
    return sorted_set(F.transform(found(text, pattern), lambda m: F.regexp_replace(strip(m), r"\s+", " ")))


def cvss_scores(text: Column, more: Column | None = None) -> Column:
    """The scores named in a text, and ``more`` from tables, distinct, highest first."""
    first, second = found(text, CVSS, 1), found(text, CVSS, 2)
    values = F.transform(F.zip_with(first, second, lambda a, b: F.when(a != "", a).otherwise(b)), lambda x: x.try_cast("double"))
    if more is not None:
        values = F.concat(values, more)
    return F.sort_array(F.array_distinct(F.filter(values, lambda x: x.isNotNull())), asc=False)


#: What ``with_terms`` adds.
TERMS = ("threat_actors", "affected_systems", "severity_keywords", "cvss_scores", "timelines")


def with_terms(df: DataFrame, text: str, table_scores: Column | None = None) -> DataFrame:
    """``df`` with the actors, systems, severity words in their order, scores and dates of a text (``TERMS``)."""
    t = F.col(text)
    return (
        df.withColumn("__w", F.transform(found(t, SEVERITY), F.upper))
        .withColumns(
            {
                "threat_actors": _terms(t, ACTORS),
                "affected_systems": _terms(t, SYSTEMS),
                "severity_keywords": F.filter(F.array(*map(F.lit, SEVERITY_ORDER)), lambda s: F.array_contains(F.col("__w"), s)),
                "cvss_scores": cvss_scores(t, table_scores),
                "timelines": _terms(t, TIMELINE),
            }
        )
        .drop("__w")
    )
