"""Fragments of SQL for DuckDB that mirror functions.text."""

from __future__ import annotations

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def title_key(x: str) -> str:
    return f"lower({collapse(x)})"


def target_key(x: str) -> str:
    return title_key(f"regexp_extract({x}, '^[^|#]*', 0)")


def word_count(x: str) -> str:
    return f"cast(coalesce(len(regexp_extract_all({x}, '{NOT_WS}+')), 0) as integer)"


def is_blank(x: str) -> str:
    return f"coalesce(not regexp_matches({x}, '{NOT_WS}'), true)"


def counting(table: str, key: str, time: str) -> str:
    """The counting row of each key, without copies."""
    return f"(select * from {table} where {key} is not null qualify row_number() over (partition by {key} order by {time} desc nulls last) = 1)"
