"""RE2 (DuckDB) spellings of our Java patterns, for the oracle SQL.

RE2 has ASCII ``\\b \\w \\d`` and no look-around, so oracle patterns spell classes out; on the
driver tables (ASCII digits, spaces and newlines only) they select the same matches.
"""

from ..functions import patterns as P


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """``\\w`` spelled out: a class of its own, or members of the class that it stands in."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two.startswith("\\"):
            out.append(two if two != r"\w" else r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]")
            i += 2
            continue
        inside = pattern[i] == "[" or (inside and pattern[i] != "]")
        out.append(pattern[i])
        i += 1
    return "".join(out)


def ci(pattern: str) -> str:
    return sq("(?i)" + re2(pattern))


def profile_steps():
    """(name, re2_pattern_sql, tag) in the default-profile order, mirroring ``Profile.regex_steps``."""
    steps = []
    for key in P.REGEX_ORDER:
        pat = P.PROFILE_REGEX_DEFAULTS.get(key)
        if pat:
            steps.append((key, ci(pat), P.REGEX_TAGS[key]))
    for key, pat in P.EXTRA_REGEX.items():
        steps.append((key, ci(pat), P.EXTRA_TAGS[key]))
    return steps
