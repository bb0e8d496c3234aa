"""Rules on text as SQL expressions, for the checks."""

from __future__ import annotations


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def cap(c: str) -> str:
    # RE2 knows \b and \s by ASCII only: the end of a word and the white space are spelled out as Spark reads them.
    gap = r"[ \t\n\x0B\f\r]+"
    return rf"regexp_replace(regexp_replace({c}, '^([B-HJ-Z]){gap}([a-z]{{2,}})', '\1\2'), '^([A-Z]){gap}([A-Z]{{2,}})([^\p{{L}}\p{{Nd}}_]|$)', '\1\2\3')"


def title_like(c: str) -> str:
    return rf"""(regexp_matches({c}, '^[A-Z0-9‘“"(]') AND NOT regexp_matches({c}, '^(?i)[0-9\s.,%/₹Rs()-]+$') AND regexp_matches({c}, '[A-Za-z]{{3}}'))"""


def debris(c: str) -> str:
    words = rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"
    figures = rf"list_filter({words}, lambda w: regexp_matches(w, '^[0-9,.]+%?/?-?$'))"
    return f"(contains({c}, '[table]') OR len({words}) = 0 OR len({figures}) * 5 > len({words}) OR (upper({c}) = {c} AND lower({c}) <> {c} AND regexp_matches({c}, '[0-9]')))"


def colon(c: str) -> str:
    head = f"split_part({c}, ': ', 1)"
    cut = strip(f"regexp_replace({head}, '[ ,;:]+$', '')")
    return f"CASE WHEN contains({c}, ': ') AND length({head}) BETWEEN 4 AND 80 AND regexp_matches({head}, '[A-Za-z]{{3}}') THEN {cut} END"
