"""Small SQL snippets the oracles share."""

from __future__ import annotations


def rnd(expression: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(round_even(CAST(({expression}) AS DOUBLE) * {scale}, 0) / {scale})"


def host(url: str) -> str:
    """Lower-case host without www., written with split_part instead of a regex."""
    authority = f"CASE WHEN strpos({url}, '://') > 0 THEN split_part(split_part(split_part({url}, '://', 2), '/', 1), '?', 1) ELSE '' END"
    return f"(CASE WHEN starts_with(lower({authority}), 'www.') THEN substr(lower({authority}), 5) ELSE lower({authority}) END)"


def clip(expression: str, low: str, high: str) -> str:
    return f"least(greatest({expression}, {low}), {high})"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def mean(expression: str, digits: int, condition: str = "") -> str:
    """Mean of values of ``digits`` decimals, summed as whole numbers."""
    where = f" FILTER ({condition})" if condition else ""
    return (
        f"(sum(round_even(CAST(({expression}) AS DOUBLE) * 1e{digits}, 0)){where} "
        f"/ (count({expression}){where} * 1e{digits}))"
    )
