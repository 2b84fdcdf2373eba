"""Checks and name lookups on a schema; no data is read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from panelloom.constants import MACROS


def require_columns(available: Iterable[str], wanted: Iterable[str], what: str = "columns") -> None:
    have = set(available)
    missing = [c for c in wanted if c not in have]
    if missing:
        raise ValueError(f"Missing {what}: {missing[:20]}")


def resolve_macro_columns(available: Iterable[str], macros: list[str] = MACROS,
                          names: Mapping[str, str | list[str]] | None = None) -> dict[str, str]:
    """Short macro name -> the panel column that holds it.

    A series is sought under the caller's `names` for it, best first, and then as `macro_<name>`, which is what
    `build_master_panel` writes. The bare name is never guessed: `bm` and `ep` are characteristics too.
    """
    have, found = set(available), {}
    for macro in macros:
        given = (names or {}).get(macro, [])
        tried = [given] if isinstance(given, str) else list(given)
        found[macro] = next((c for c in [*tried, f"macro_{macro}"] if c in have), None)
    missing = [m for m, c in found.items() if c is None]
    if missing:
        alike = sorted(c for c in have if any(m in c.lower() for m in macros))
        raise ValueError(f"No column found for macro series {missing}; pass `names`. Columns with similar names: "
                         f"{alike[:100]}")
    return found
