"""Search planning on the driver: the texts of queries and the selection of sources, from one short request."""

from __future__ import annotations

from dataclasses import dataclass, field

MOST_PREFIXES = 50


def branch_query(branch: str, keywords: str | None, region: str | None) -> str:
    """The request's own words in the order typed; a web search has no other place for the region."""
    return " ".join(x for x in (branch.strip(), (keywords or "").strip(), (region or "").strip()) if x)


def job_board_term(branch: str, keywords: str | None) -> str:
    """As ``branch_query``, without the region, for which a job board has a parameter."""
    return branch_query(branch, keywords, None)


def category_prefixes(codes: list[str]) -> list[str]:
    """Distinct digit prefixes without closing zeros, of two digits or more."""
    out = []
    for code in codes:
        if not code.isdigit() or len(code) > 8:
            raise ValueError(f"not a category code: {code!r}")
        out.append(code.rstrip("0").ljust(2, "0"))
    if len(set(out)) > MOST_PREFIXES:
        raise ValueError(f"more than {MOST_PREFIXES} prefixes")
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Budget:
    """Limits of a run for a number of wanted records."""

    target: int
    pages: int
    candidates: int
    seconds: int


def run_budget(target: float, breadth: float = 1.0) -> Budget:
    """Pages, candidates and seconds for ``target`` records; numbers are rounded half up and clamped."""

    def clamp(x: float, low: int, high: int) -> int:
        return int(min(high, max(low, (x + 0.5) // 1)))

    wanted = clamp(target, 1, 100)
    return Budget(
        wanted, clamp((wanted * 2.5 + 5) * breadth, 10, 200), clamp(wanted * 12 * breadth, 60, 500), clamp((wanted * 4 + 40) * breadth, 60, 240)
    )


@dataclass
class Selection:
    used: list[str] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)


def select_sources(registered: dict[str, list[str]], breadth: str, asked: list[str] | None = None) -> Selection:
    """Sources asked for by name, else those of a breadth tier; in order of registration."""
    if asked:
        return Selection([s for s in registered if s in asked], [a for a in asked if a not in registered])
    return Selection([s for s, tiers in registered.items() if breadth in tiers])
