"""What goes together: which distances take ragged or multivariate series or need a window, and which prototypes each type of clustering has.

One table for each; `check` looks at a request once, at the front door of clustering, by one profile of the series. `fits` is the
same for series that meet prototypes (predictions, and prototypes made by functions of the caller's).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from chronoloom.sources.series import SeriesError, check_profile, check_window


@dataclass(frozen=True)
class Distance:
    name: str
    kernel: Callable | None = None  # of stacked pairs
    prepare: Callable | None = None  # of a stack of series and the length of the others: what the kernel takes of each, by name
    expression: Callable | None = None  # of columns x, y
    ragged: bool = False
    multivariate: bool = False
    symmetric: Callable = lambda a: True  # of the arguments
    diagonal: bool = False  # self-distances aren't 0
    bound: bool = False  # from an envelope, which needs a window narrower than the series
    outer: Callable = lambda a: None  # of the arguments: the kernel of all pairs of two stacks, where there is one


REGISTRY: dict[str, Distance] = {}


def register(distance: Distance, *names: str) -> None:
    for n in (distance.name, *names):
        REGISTRY[n.lower()] = distance


def lookup(name: str) -> Distance:
    if name.lower() not in REGISTRY:
        raise SeriesError(f"No distance is known as '{name}'.")
    return REGISTRY[name.lower()]


HARD = frozenset({"partitional", "hierarchical", "tadpole"})
SOFT = frozenset({"fuzzy"})


@dataclass(frozen=True)
class Prototype:
    types: frozenset[str]
    ragged: bool
    multivariate: bool = True


#: Prototypes by name. Those that average point by point need series of one length.
PROTOTYPES = {
    "pam": Prototype(HARD, ragged=True),
    "mean": Prototype(HARD, ragged=False),
    "median": Prototype(HARD, ragged=False),
    "dba": Prototype(HARD, ragged=True),
    "shape": Prototype(HARD, ragged=True, multivariate=False),
    "sdtw_cent": Prototype(HARD, ragged=True),
    "fcm": Prototype(SOFT, ragged=False),
    "fcmdd": Prototype(SOFT, ragged=True),
}
DEFAULTS = {"partitional": "pam", "hierarchical": "pam", "fuzzy": "fcm", "tadpole": "pam"}


def _names(rows: dict, fits) -> str:
    return ", ".join(sorted(n for n, r in rows.items() if fits(r)))


def check_bound_window(window: int, length: int) -> None:
    if window >= length:
        raise SeriesError(f"An envelope of {window} points to either side is wider than a series of {length}.")


def check_distance(method: str, known: dict, window: int | None = None) -> None:
    """Raises SeriesError unless series of this profile go with the distance; known: profile()."""
    rule = lookup("lbi" if method == "dtw_lb" else method)
    name = "dtw_lb" if method == "dtw_lb" else rule.name
    if known["most_vars"] > 1 and not rule.multivariate:
        raise SeriesError(f"{name} takes series of one variable; several: {_names(REGISTRY, lambda r: r.multivariate)}.")
    if known["shortest"] != known["longest"] and not rule.ragged:
        raise SeriesError(f"{name} takes series of one length; different lengths: {_names(REGISTRY, lambda r: r.ragged)}.")
    if check_window(window, required=rule.bound) is not None and rule.bound:
        check_bound_window(window, known["longest"])


def check_prototype(centroid, type: str, known: dict) -> None:
    """Raises SeriesError unless this prototype is one of the type's and takes series of this profile. Functions are the caller's matter."""
    if callable(centroid):
        return
    rule = PROTOTYPES.get(centroid)
    if rule is None or type not in rule.types:
        raise SeriesError(f"A {type} clustering has no prototype '{centroid}'; it has {_names(PROTOTYPES, lambda r: type in r.types)}.")
    if known["shortest"] != known["longest"] and not rule.ragged:
        raise SeriesError(f"The prototype {centroid} takes series of one length; different lengths: {_names(PROTOTYPES, lambda r: type in r.types and r.ragged)}.")
    if known["most_vars"] > 1 and not rule.multivariate:
        raise SeriesError(f"The prototype {centroid} takes series of one variable.")


def check_k(k: int, n: int) -> None:
    if k < 2:
        raise SeriesError("A clustering has two clusters or more.")
    if k >= n:
        raise SeriesError("There must be more series than clusters.")


def check(known: dict, type: str, k: int, distance: str, centroid, window: int | None = None) -> None:
    """Everything of a request that its series' profile can rule out."""
    check_profile(known)
    check_k(k, known["n"])
    if type == "tadpole":
        check_distance("lbk", known, window)
    else:
        check_distance(distance, known, window)
    check_prototype(centroid, type, known)


def fits(method: str, series: dict, points: dict) -> None:
    """Raises SeriesError unless series and prototypes (profiles) can be compared by the distance."""
    if series["n"] and points["n"]:
        if series["most_vars"] != points["most_vars"]:
            raise SeriesError("Series and prototypes differ in how many variables they have.")
        both = {"shortest": min(series["shortest"], points["shortest"]), "longest": max(series["longest"], points["longest"]), "most_vars": series["most_vars"]}
        rule = lookup("lbi" if method == "dtw_lb" else method)
        if both["shortest"] != both["longest"] and not rule.ragged:
            raise SeriesError(f"{rule.name} takes series and prototypes of one length.")


def profile_of(points: list) -> dict:
    """The profile of a few arrays on the driver."""
    sizes, inner = [len(p) for p in points], [len(x) if isinstance(x, (list, tuple)) else 1 for p in points for x in p]
    return {"n": len(points), "shortest": min(sizes, default=0), "longest": max(sizes, default=0), "least_vars": min(inner, default=1), "most_vars": max(inner, default=1)}
