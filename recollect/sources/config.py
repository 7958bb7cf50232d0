"""A tenant's settings: how long its memory and its audit lines are kept, as a TOML file beside its store."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass

from recollect.sources.store import Store

DEFAULT_DAYS = 30


@dataclass(frozen=True)
class Retention:
    """Days that chunks and audit lines are kept; 0 is for ever."""

    days: int = DEFAULT_DAYS
    audit_days: int = DEFAULT_DAYS


def _path(store: Store) -> str:
    return f"{store.home}/config.toml"


def _tables(store: Store) -> dict:
    try:
        return tomllib.loads(store.read_text(_path(store)) or "")
    except (tomllib.TOMLDecodeError, UnicodeDecodeError):
        return {}


def read(store: Store, default: int = DEFAULT_DAYS) -> Retention:
    """The tenant's retention. Without a file, an entry or a whole number of at least 0 the default holds; audit lines follow the chunks."""
    held = _tables(store).get("retention")
    held = held if isinstance(held, dict) else {}
    pick = lambda name, other: held[name] if type(held.get(name)) is int and held[name] >= 0 else other
    days = pick("days", default)
    return Retention(days, pick("audit_days", days))


def write(store: Store, days: int, audit_days: int | None = None) -> None:
    """Set the retention and keep the tenant's name; audit_days None: as days. Readers see the old file or the new one."""
    for n in (days, audit_days):
        if n is not None and (type(n) is not int or n < 0):
            raise ValueError("INVALID_INPUT: days are whole numbers of at least 0")
    tenant = _tables(store).get("tenant")
    name = tenant.get("name") if isinstance(tenant, dict) else None
    lines = ["[tenant]", f"name = {json.dumps(name if isinstance(name, str) else '')}", "", "[retention]", f"days = {days}"]
    store.write_text(_path(store), "\n".join(lines + ([] if audit_days is None else [f"audit_days = {audit_days}"])) + "\n", replace=True)
