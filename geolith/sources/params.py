"""Parameter sets from XML: lists of values, expansion to runs, filters and order."""

from __future__ import annotations

from dataclasses import dataclass, fields
from itertools import product
from xml.etree import ElementTree

Params = dict[str, list[str]]


@dataclass
class Defaults:
    """Parameters of a reconstruction that a set may leave out."""

    dim: str = "3"
    mode: str = "0"
    max_ppt: str = "10000"
    min_ppt: str = "50"
    depth: str = "4"
    nb_samples: str = "3"
    max_opt_it: str = "30"
    coef_mult: str = "1"
    lambda_: str = "1"
    pscale: str = "1"
    seed: str = "18696"


def parse_sets(xml: str) -> dict[str, Params]:
    """Name of each child of <datasets> -> its parameters, values split at commas, in the order they are written, each once."""
    root = ElementTree.fromstring(xml)
    sets = root if root.tag == "datasets" else root.find("datasets")
    if sets is None:
        raise ValueError("no <datasets>")
    return {s.tag: {p.tag: list(dict.fromkeys(v.strip() for v in (p.text or "").split(",") if v.strip())) for p in s} for s in sets}


def truth(p: Params, key: str, default: bool) -> bool:
    return (p.get(key, [str(default)])[0]).lower() in ("true", "1", "yes")


def expand(p: Params) -> list[Params]:
    """Every combination of values. nbp_and_depth pairs (a:b) stay together and become nbp and depth."""
    p = {k: v for k, v in p.items() if k not in ("do_expand", "do_process", "sort_criterion")}
    pairs = p.pop("nbp_and_depth", [])
    runs = [dict(zip(p, [[v] for v in combo])) for combo in product(*p.values())]
    if pairs:
        runs = [r | {"nbp": [a], "depth": [b]} for r in runs for a, b in (x.split(":") for x in pairs)]
    return runs


def ordered(runs: list[Params], criterion: str | None) -> list[Params]:
    """'key:gt' falling, 'key:lt' rising, by number; runs that tie keep their order."""
    if not criterion:
        return runs
    key, _, how = criterion.partition(":")
    return sorted(runs, key=lambda r: float(r[key][0]), reverse=how == "gt")


def parameter_runs(xml: str) -> dict[str, list[Params]]:
    """All runs of all sets that are to be processed."""
    out = {}
    for name, p in parse_sets(xml).items():
        if truth(p, "do_process", True):
            runs = expand(p) if truth(p, "do_expand", False) else [p]
            out[name] = ordered(runs, p.get("sort_criterion", [None])[0])
    return out


def with_defaults(p: Params) -> Params:
    return {f.name.rstrip("_"): p.get(f.name.rstrip("_"), [f.default]) for f in fields(Defaults)} | p


def command(p: Params) -> list[str]:
    """As a flat list of --key value."""
    return [x for k, v in p.items() for x in (f"--{k}", " ".join(v))]


def sweep(algorithms: list[str], lambdas: list[float], multipliers: list[float], default: str, fixed: tuple[float, ...] = (1.0, 5.0, 10.0)) -> list[tuple[str, float, float]]:
    """Runs of an algorithm by lambda and multiplier (falling); algorithms other than the default take fixed multipliers."""
    return [(a, lam, m) for a in algorithms for lam in lambdas for m in (sorted(multipliers, reverse=True) if a == default else fixed)]
