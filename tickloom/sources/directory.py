"""Remote connector directories: rows of JSON to ingress entries. Fetching them is the caller's affair."""

from __future__ import annotations

import json
from dataclasses import dataclass

#: Protocols that there is a source for.
PROTOCOLS = ("itch",)


@dataclass(frozen=True)
class Ingress:
    name: str
    protocol: str
    url: str
    symbols: tuple[str, ...]


def entries(text: str) -> list[Ingress]:
    """Complete entries of a JSON array with a known protocol; without symbols they stand for all, *."""
    try:
        rows = json.loads(text)
    except ValueError:
        return []
    out = []
    for row in rows if isinstance(rows, list) else []:
        if not isinstance(row, dict):
            continue
        name, protocol, url = (row.get(k) for k in ("name", "protocol", "endpointUrl"))
        if all(isinstance(x, str) and x for x in (name, protocol, url)) and protocol.lower() in PROTOCOLS:
            symbols = tuple(s for s in row.get("symbols") or [] if isinstance(s, str) and s) or ("*",)
            out.append(Ingress(name, protocol.lower(), url, symbols))
    return out
