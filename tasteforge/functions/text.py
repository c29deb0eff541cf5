"""Text expressions: category lists, metric names, hyper-parameter text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

NOT_FOUND = "NotFound"

# Fixed: one "('name', value)" pair of a logged parameter list.
PAIR_PATTERN = r"\('([^']+)', ('[^']*'|[^)]*)\)"


def comma_parts(column: str) -> Column:
    """Trimmed parts of a comma list; NULL stays NULL."""
    return F.transform(F.split(F.col(column), ","), lambda part: F.trim(part))


def first_known(parts: Column, known: Column | Sequence[str]) -> Column:
    """First part found in ``known``, in the order of the list, else NotFound."""
    allowed = known if isinstance(known, Column) else F.array(*[F.lit(k) for k in known])
    return F.coalesce(F.get(F.array_intersect(parts, allowed), F.lit(0)), F.lit(NOT_FOUND))


def metric_at(name: str, k: int) -> str:
    """Logged name of a ranking metric, such as ``ndcg@10``."""
    return f"{name}@{k}"


def metric_k(column: str = "metric") -> Column:
    """The K of ``ndcg@K``; NULL for metrics without one."""
    return F.try_element_at(F.split(F.col(column), "@"), F.lit(2)).try_cast("int")


def hyper_pairs(column: str = "hyper") -> Column:
    """``[('k', 16), ('reg', 0.1)]`` as an array of (name, value) structs.

    The text is matched, never evaluated as code.
    """
    names = F.expr(f"regexp_extract_all({column}, r\"{PAIR_PATTERN}\", 1)")
    values = F.expr(f"regexp_extract_all({column}, r\"{PAIR_PATTERN}\", 2)")
    return F.zip_with(
        names,
        values,
        lambda n, v: F.struct(n.alias("params_name"), F.trim(F.regexp_replace(v, "'", "")).alias("params_val")),
    )


def hyper_text(params: Mapping[str, object]) -> str:
    """Canonical text of a parameter dictionary: name order, Python literals."""
    return str(sorted(params.items()))


def canonical_hyper(column: str = "hyper") -> Column:
    """``name_value-name_value`` in name order: the directory name of a run."""
    pairs = F.array_sort(hyper_pairs(column))
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("_", p["params_name"], p["params_val"])), "-")


def params_dirname(params: Mapping[str, object]) -> str:
    """The same directory name from a dictionary."""
    return "-".join(f"{name}_{value}" for name, value in sorted(params.items()))
