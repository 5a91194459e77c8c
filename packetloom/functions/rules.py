"""Stateless rules over single records: HTTP, TLS, user agents, ports, certificates, Modbus, SMB, IDS, notices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import ip as ips, text

# Patterns of request targets, by detector.
HTTP_PATTERNS = (
    ("http_webshell", "malware", 8,
     r"(?i)(?:/(?:c99|r57|b374k|wso|c100|shell|cmd|backdoor|webshell|antichat|mini[_-]?shell)\b|/(?:tmp|uploads?|images?)/[a-z0-9_]+\.(?:php|jsp|asp|aspx)\b|\.(?:php|asp|aspx|jsp);\b)"),
    ("http_sqli", "exploit", 7,
     r"(?i)(?:union(?:\s|/\*.*?\*/|\+)+select|'\s*or\s*'?\d'?\s*=\s*'?\d|\bor\s+1\s*=\s*1\b|sleep\(\s*\d|benchmark\(\s*\d|information_schema|;\s*drop\s+table|waitfor\s+delay)"),
    ("http_cmd_injection", "exploit", 8,
     r"(?i)(?:;\s*(?:cat|wget|curl|nc|bash|sh|powershell|whoami|id|uname)\b|\|\s*(?:nc|bash|sh|powershell)\b|\$\([^)]+\)|%0a(?:cat|wget|curl|id)\b)"),
    ("http_path_traversal", "exploit", 7,
     r"(?i)(?:\.\./\.\./|\.\.\\|\.\.%2f|%2e%2e%2f|/etc/passwd|/proc/self/environ|php://(?:filter|input)|file:///|data://text)"),
    ("http_cred_in_url", "credential_access", 5,
     r"(?i)[?&](?:password|passwd|pwd|token|apikey|api_key|secret|access_key|auth)=[^&\s]+"),
)
RISKY_METHODS = ("PUT", "DELETE", "PROPFIND", "PROPPATCH", "MKCOL", "COPY", "MOVE", "TRACE", "CONNECT", "SEARCH")
# User agents of tools, in order of precedence.
TOOL_AGENTS = (
    "curl/", "wget/", "python-requests", "python-urllib", "go-http-client", "powershell", "certutil", "bitsadmin", "nmap", "sqlmap", "masscan",
    "libwww-perl", "winhttp", "java/", "empire", "cobalt",
)
# Hosts for sharing data, in order of precedence.
STAGING_HOSTS = (
    "dropbox.com", "dropboxusercontent", "drive.google", "docs.google", "storage.googleapis", "onedrive", "1drv.ms", "mega.nz", "mega.io",
    "wetransfer", "pastebin.com", "transfer.sh", "anonfiles", "gofile.io", "s3.amazonaws", "backblazeb2", "sendspace", "file.io",
)
# Resolvers over HTTPS, in order of precedence.
DOH_HOSTS = (
    "cloudflare-dns.com", "dns.google", "dns.quad9.net", "doh.opendns", "mozilla.cloudflare-dns", "dns.adguard", "doh.cleanbrowsing", "dns.nextdns",
    "chrome.cloudflare-dns",
)
# Application protocol expected on a port.
PORT_PROTOCOLS = {
    22: "ssh", 21: "ftp", 25: "smtp", 587: "smtp", 465: "smtp", 53: "dns", 80: "http", 8080: "http", 443: "tls", 8443: "tls",
    110: "pop3", 995: "pop3", 143: "imap", 993: "imap", 445: "smb", 139: "smb", 3389: "rdp", 1883: "mqtt",
}
JA4 = r"^[tqd](?:1[0-3]|s[23]|d[12]|00)[di][0-9]{4}[a-z0-9]{2}_[0-9a-f]{12}_[0-9a-f]{12}$"


def lookup(table: dict, value: Column, default: Column | None = None) -> Column:
    """A literal map as an expression; null (or the default) for values it lacks."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    out = F.try_element_at(m, value)
    return out if default is None else F.coalesce(out, default)


def http_rules(method: Column, url: Column) -> Column:
    """Array of (detector, category, severity) of the rules that a request meets, in fixed order."""
    u = F.coalesce(url, F.lit(""))
    hits = [F.struct(u.rlike(p).alias("hit"), F.lit(d).alias("detector_id"), F.lit(c).alias("category"), F.lit(s).alias("severity")) for d, c, s, p in HTTP_PATTERNS]
    risky = F.coalesce(F.upper(method).isin(*RISKY_METHODS), F.lit(False))
    hits.append(F.struct(risky.alias("hit"), F.lit("http_suspicious_method").alias("detector_id"), F.lit("c2").alias("category"), F.lit(5).alias("severity")))
    return F.filter(F.array(*hits), lambda x: x["hit"])


def suspicious_agent(agent: Column) -> Column:
    """Why a user agent is suspicious: empty_ua, or the first tool name in it; null if it is not."""
    return F.when(F.coalesce(agent, F.lit("")) == "", F.lit("empty_ua")).otherwise(text.first_hit(agent, TOOL_AGENTS))


def cloud_staging(sni: Column) -> Column:
    return text.first_hit(sni, STAGING_HOSTS)


def encrypted_dns(sni: Column, port: Column, approved: tuple[str, ...] = ()) -> Column:
    """dot:853, or doh: and the resolver in a name that is not approved; null otherwise."""
    hit = text.first_hit(sni, DOH_HOSTS)
    allowed = F.coalesce(F.lower(sni).isin(*approved), F.lit(False)) if approved else F.lit(False)
    return F.when(port == 853, F.lit("dot:853")).when(hit.isNotNull() & ~allowed, F.concat(F.lit("doh:"), hit))


def port_mismatch(app: Column, port: Column, allow: tuple[int, ...] = ()) -> Column:
    """'ssh on port 443 (expected tls)', or null. ssl is tls; unknown and failed protocols are skipped."""
    got = F.lower(app)
    got = F.when(got == "ssl", F.lit("tls")).otherwise(got)
    want = lookup(PORT_PROTOCOLS, port.try_cast("int"))
    skip = got.isin("", "failed", "unknown") | (port.isin(*allow) if allow else F.lit(False))
    return F.when(~skip & (got != want), F.concat(got, F.lit(" on port "), port.cast("string"), F.lit(" (expected "), want, F.lit(")")))


def cert_anomaly(subject: Column, issuer: Column, not_before: Column, not_after: Column) -> Column:
    """self_signed, short_validity (under two days; times that do not parse never are), or null."""
    from .time import epoch, event_time

    own = (subject != "") & (F.trim(subject) == F.trim(issuer))
    days = (epoch(event_time(not_after)) - epoch(event_time(not_before))) / 86400
    return F.when(own, F.lit("self_signed")).when(days < 2, F.lit("short_validity"))


def ja4_valid(fp: Column) -> Column:
    return F.coalesce(fp.rlike(JA4), F.lit(False))


def ja4_ac(fp: Column) -> Column:
    """First and last part of a valid JA4; null otherwise."""
    p = F.split(fp, "_")
    return F.when(ja4_valid(fp), F.concat_ws("_", F.get(p, F.lit(0)), F.get(p, F.lit(2))))


def bare_host(host: Column) -> Column:
    """Lower case, without port and without www."""
    return F.regexp_replace(F.get(F.split(F.trim(F.lower(host)), ":"), F.lit(0)), "^www\\.", "")


def host_sni_mismatch(sni: Column, host: Column) -> Column:
    return F.coalesce((sni != "") & (host != "") & (bare_host(sni) != bare_host(host)), F.lit(False))


def ech_present(tls_json: Column) -> Column:
    """Whether a TLS record (JSON) shows Encrypted Client Hello."""
    flag = F.lower(F.get_json_object(tls_json, "$.ech"))
    exts = F.lower(F.coalesce(F.get_json_object(tls_json, "$.extensions"), F.get_json_object(tls_json, "$.client_extensions"), F.lit("")))
    named = F.array_contains(F.json_object_keys(tls_json), "encrypted_client_hello")
    listed = exts.rlike('(^|[\\[,"\\s])(ech|encrypted_client_hello|65037|0xfe0d|fe0d)($|[\\],"\\s])')
    return F.coalesce(flag.isNotNull() & ~flag.isin("false", "0", "", "null"), F.lit(False)) | F.coalesce(named, F.lit(False)) | listed


# SMB pipes and DCERPC interfaces of remote execution tools.
EXEC_PIPES = {"svcctl": "service control (PsExec)", "atsvc": "scheduled task (at)", "winreg": "remote registry", "samr": "SAM remote", "lsarpc": "LSA remote"}
EXEC_INTERFACES = {
    "367abb81-9844-35f1-ad32-98f038001003": "svcctl (service create/start — PsExec)",
    "1ff70682-0a51-30e8-076d-740be8cee98b": "atsvc (scheduled task)",
    "86d35949-83c9-4044-b424-db363231fd0c": "ITaskSchedulerService",
    "4b324fc8-1670-01d3-1278-5a47bf6ee188": "srvsvc (share enum)",
    "8a885d04-1ceb-11c9-9fe8-08002b104860": "IWbemServices (WMI/DCOM exec)",
}
ADMIN_PORTS = (445, 3389, 5985, 5986, 135, 139, 22, 23, 1433, 3306, 5432, 5900)


def pipe_name(name: Column) -> Column:
    """The last part of an SMB pipe path, in lower case."""
    return F.element_at(F.split(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("\\"), F.lit("/")), "/", -1), -1)


def lateral_signals(pipes: Column, interfaces: Column, winrm_targets: Column) -> Column:
    """Array of remote execution signals: pipes, DCERPC interfaces, WinRM targets."""
    empty = F.array().cast("array<string>")
    keys = F.transform(F.coalesce(pipes, empty), pipe_name)
    a = F.transform(F.filter(keys, lambda k: k.isin(*EXEC_PIPES)), lambda k: F.concat(F.lit("pipe:"), k, F.lit(" ("), lookup(EXEC_PIPES, k), F.lit(")")))
    ids = F.transform(F.coalesce(interfaces, empty), F.lower)
    b = F.transform(F.filter(ids, lambda u: u.isin(*EXEC_INTERFACES)), lambda u: F.concat(F.lit("dcerpc:"), lookup(EXEC_INTERFACES, u)))
    n = F.size(F.array_distinct(F.filter(F.coalesce(winrm_targets, empty), lambda t: t != "")))
    c = F.when(F.size(F.coalesce(winrm_targets, empty)) > 0, F.array(F.concat(F.lit("winrm:"), n.cast("string"), F.lit(" target(s)")))).otherwise(empty)
    return F.concat(a, b, c)


def dcerpc_interfaces(dcerpc: Column) -> Column:
    """Interface UUIDs of a DCERPC record (JSON): interfaces[].uuid, then the scalar spellings; distinct, in order."""
    listed = F.from_json(F.get_json_object(dcerpc, "$.interfaces"), "array<struct<uuid:string>>")
    scalar = [F.get_json_object(dcerpc, f"$.{k}") for k in ("interface_uuid", "uuid", "interface.uuid", "interface")]
    flat = F.concat(F.coalesce(F.transform(listed, lambda x: x["uuid"]), F.array().cast("array<string>")), F.array(*scalar))
    return F.array_distinct(F.transform(F.filter(F.array_compact(flat), lambda u: u.rlike("^[0-9A-Fa-f-]{36}$")), F.lower))


# Modbus function codes by intent.
MODBUS_READ = (1, 2, 3, 4, 7, 11, 12, 17, 20, 24)
MODBUS_WRITE = (5, 6, 15, 16, 21, 22, 23)
MODBUS_DIAGNOSTIC = (8,)
MODBUS_PROGRAM = (40, 90, 125)


def modbus_fields(modbus: Column) -> Column:
    """Struct (fc, access, unit_id, is_error) of a Modbus record (JSON), over the known spellings of its fields."""
    j = lambda p: F.get_json_object(modbus, p)
    fc = F.coalesce(j("$.function.code"), j("$.function.raw"), j("$.function"), j("$.function_code")).try_cast("int")
    access = F.coalesce(F.nullif(j("$.access_type"), F.lit("")), j("$.access.type"), j("$.access"), F.lit(""))
    unit = F.coalesce(j("$.unit_id"), j("$.unit"), j("$.uid"))
    error = F.lower(F.coalesce(F.nullif(j("$.error_flags"), F.lit("")), F.nullif(j("$.exception"), F.lit("")), F.nullif(j("$.error"), F.lit("")), j("$.errors"), F.lit("")))
    return F.struct(fc.alias("fc"), F.upper(access).alias("access"), unit.alias("unit_id"), (~error.isin("0", "none", "false", "no_error", "", "null", "[]", "{}")).alias("is_error"))


def modbus_write(fc: Column, access: Column) -> Column:
    return F.coalesce(fc.isin(*MODBUS_WRITE), F.lit(False)) | F.coalesce(F.upper(access).contains("WRITE"), F.lit(False))


def modbus_program(fc: Column) -> Column:
    return F.coalesce(fc.isin(*MODBUS_PROGRAM), F.lit(False))


def modbus_port(port: Column, allow: tuple[int, ...] = ()) -> Column:
    """Whether Modbus is seen on a port that is neither 502 nor allowed; false for what is no port."""
    return F.coalesce(~port.try_cast("int").isin(502, *allow), F.lit(False))


# Signatures that are not threats, and categories of alerts.
NOISE_SIGNATURES = (
    "SURICATA STREAM", "SURICATA Ethertype", "SURICATA UDP", "SURICATA TCP", "SURICATA IP", "SURICATA ICMP", "SURICATA zero", "SURICATA DNS",
    "ET INFO", "ET POLICY", "GPL POLICY",
)
ALERT_CATEGORIES = {
    "a network trojan was detected": "c2",
    "malware command and control activity detected": "c2",
    "misc attack": "c2",
    "attempted denial of service": "anomaly",
    "attempted information leak": "recon",
    "detection of a network scan": "recon",
    "potential corporate privacy violation": "exfil",
    "exfiltration": "exfil",
    "successful administrator privilege gain": "lateral",
    "attempted administrator privilege gain": "lateral",
    "attempted user privilege gain": "lateral",
    "web application attack": "exploit",
    "exploit kit activity detected": "malware",
    "targeted malicious activity was detected": "malware",
}


def is_threat_alert(signature: Column, severity: Column, signature_severity: Column) -> Column:
    """No noise signature, and severity 2 or less or marked major or critical; a severity that is no number never is.

    signature_severity is the text of the alert's metadata of that name.
    """
    noise = F.coalesce(signature, F.lit("")).rlike("^(" + "|".join(NOISE_SIGNATURES) + ")")
    level = severity.try_cast("int")
    marked = F.coalesce(F.lower(signature_severity).rlike("major|critical"), F.lit(False))
    return ~noise & level.isNotNull() & (F.coalesce(level <= 2, F.lit(False)) | marked)


def alert_category(category: Column) -> Column:
    return lookup(ALERT_CATEGORIES, F.trim(F.lower(category)), F.lit("anomaly"))


# Notices of the protocol analyser as (category, severity).
NOTICES = {
    "Intel::Notice": ("c2", 8), "SSL::Invalid_Server_Cert": ("c2", 6), "SSL::Certificate_Expired": ("c2", 5), "SSL::Weak_Key": ("c2", 5),
    "SSL::Old_Version": ("c2", 4), "Scan::Address_Scan": ("recon", 5), "Scan::Port_Scan": ("recon", 5), "Traceroute::Detected": ("recon", 4),
    "TeamCymruMalwareHashRegistry::Match": ("malware", 9), "Signatures::Sensitive_Signature": ("c2", 6),
}
NOTICE_PREFIXES = {
    "Intel": ("c2", 8), "SSL": ("c2", 5), "X509": ("c2", 5), "Scan": ("recon", 5), "Signatures": ("c2", 6), "SMB": ("lateral", 6),
    "Kerberos": ("credential_access", 6), "DNS": ("c2", 5), "HTTP": ("c2", 5), "Weird": ("anomaly", 4),
}
NOTICE_DEFAULT = ("malware", 6)
OPERATIONAL_NOTICES = ("CaptureLoss", "PacketFilter", "Software")


def notice_class(note: Column) -> Column:
    """Struct (category, severity) of a notice: by its whole name, else by its framework, else the default."""
    head = F.get(F.split(note, "::"), F.lit(0))
    part = lambda i: F.coalesce(lookup({k: v[i] for k, v in NOTICES.items()}, note), lookup({k: v[i] for k, v in NOTICE_PREFIXES.items()}, head), F.lit(NOTICE_DEFAULT[i]))
    return F.struct(part(0).alias("category"), part(1).alias("severity"))


def is_operational_notice(note: Column, drop: tuple[str, ...] = OPERATIONAL_NOTICES) -> Column:
    return F.coalesce(note.rlike("^(" + "|".join(drop) + ")(::|$)"), F.lit(False))


# Stream anomalies that tell of evasion.
STREAM_TELLS = ("overlap_different_data", "data_after_reset", "reassembly", "3whs", "wrong_thread")


def is_threat_anomaly(kind: Column, event: Column) -> Column:
    k = F.lower(kind)
    return F.coalesce((k == "applayer") | ((k == "stream") & text.contains_any(event, STREAM_TELLS)), F.lit(False))


def is_checksum_anomaly(kind: Column, event: Column) -> Column:
    return ~is_threat_anomaly(kind, event) & F.coalesce(F.lower(event).contains("checksum"), F.lit(False))


# MIME types of executables.
EXECUTABLE_TYPES = (
    "application/x-dosexec", "application/x-msdownload", "application/vnd.microsoft.portable-executable", "application/x-elf",
    "application/x-executable", "application/x-mach-binary", "application/x-sharedlib",
)


def hash_is_complete(sha256: Column, state: Column, gaps: Column, start: Column) -> Column:
    """Whether a file's digest covers the whole file: closed, known to have no gaps, from offset 0 or none given."""
    return F.coalesce((sha256 != "") & (F.upper(state) == "CLOSED") & gaps.eqNullSafe(F.lit(False)) & (F.coalesce(start, F.lit(0)) == 0), F.lit(False))


def external_agent(agent: Column, dst: Column) -> Column:
    """suspicious_agent for external destinations only."""
    return F.when(ips.is_external(dst), suspicious_agent(agent))
