"""Guards and small renderings on the driver: canonical paths, redaction, line ranges, searchable terms."""

from __future__ import annotations

import re
import unicodedata

#: Device names that no relative path may hold.
DEVICES = frozenset(["con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]])
_SECRETS = (
    re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S),
    re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    re.compile(r"(?i)\b(bearer|token|password|secret|api[_-]?key)\b(\s*[:=]\s*|\s+)(\S+)"),
    re.compile(r"(?<=://)[^/\s:@]+:[^/\s@]+(?=@)"),
)


def canonical_path(path: str) -> str:
    """A relative path in NFC with ``/``; absolute paths, drives, shares, devices and escapes are refused."""
    plain = unicodedata.normalize("NFC", path).replace("\\", "/")
    if not plain or plain.startswith("/") or re.match(r"[A-Za-z]:", plain) or "\0" in plain:
        raise ValueError(f"{path!r} is no relative path")
    parts: list[str] = []
    for part in plain.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if not parts:
                raise ValueError(f"{path!r} leaves its root")
            parts.pop()
        elif part.split(".")[0].lower() in DEVICES:
            raise ValueError(f"{path!r} names a device")
        else:
            parts.append(part)
    if not parts:
        raise ValueError(f"{path!r} names nothing")
    return "/".join(parts)


def is_canonical(path: str) -> bool:
    """Whether a relative path is safe and already in its canonical form."""
    try:
        return canonical_path(path) == path
    except ValueError:
        return False


def redact(message: str) -> str:
    """A message without what looks like a credential."""
    for pattern in _SECRETS:
        message = pattern.sub(lambda m: f"{m[1]}{m[2]}[redacted]" if m.lastindex == 3 else "[redacted]", message)
    return message


def line_range(start: int | None, end: int | None) -> str:
    if start is None or start <= 0:
        return ""
    return f"line {start}" if end is None or end <= start else f"lines {start}-{end}"


def searchable_terms(text: str, most: int = 3, least: int = 4) -> list[str]:
    """The first few different words of at least four characters."""
    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) >= least))[:most]
