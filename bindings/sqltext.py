"""SQL fragments shared by the oracles (DuckDB dialect, RE2 patterns)."""

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def name_key(c: str) -> str:
    bare = rf"regexp_replace({c}, '(?i)^(the|a|an)\s+', '')"
    return rf"lower(trim(regexp_replace({bare}, '[^a-zA-Z0-9 ]', '', 'g')))"


def variant_key(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '\s*\(.*?\)\s*', '', 'g')))"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: length(x) > 2)"


def words(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+(?:[''.][\p{{L}}\p{{N}}]+)*')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def drop(c: str, *patterns: str) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


def link_labels(c: str) -> str:
    return rf"regexp_replace({c}, '\[\[([^\]|]+\|)?([^\]]+)\]\]', '\2', 'g')"


TITLE = "regexp_extract(html, '<h1>([^<]+)</h1>', 1)"
HOST = "regexp_extract(url, '^https?://([^/]+)/', 1)"
SECTION = "regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1)"
PAGE_NO = r"coalesce(try_cast(regexp_extract(url, '[?&]page=(\d+)', 1) AS INTEGER), 1)"
