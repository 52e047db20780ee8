"""Column functions over text: portable regular expressions, entropy, masks, fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: An ASCII word boundary: Java's \b follows Unicode, the rules' does not.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


#: The same where a word character is known to follow, which is much cheaper at every place of a text.
BEFORE_WORD = r"(?<![A-Za-z0-9_])"


def _group_end(pattern: str, at: int) -> int:
    """Where the group that opens at a place of the pattern closes."""
    depth = 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|[()]", pattern[at:]):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0:
            return at + m.start()
    return len(pattern)


def _word_follows(pattern: str, at: int) -> bool:
    """Whether what stands at a place of the pattern starts with a word character in every case."""
    rest = pattern[at:]
    opened = re.match(r"\((?:\?:)?(?!\?)", rest)
    if opened:
        end = _group_end(pattern, at)
        inner = pattern[at + opened.end() : end]
        if pattern[end + 1 : end + 2] in ("?", "*") or pattern[end + 1 : end + 3] == "{0" or re.search(r"[()\[\\]", inner):
            return False
        return all(re.match(r"[A-Za-z0-9_](?![?*]|\{0)", x) for x in inner.split("|"))
    return bool(re.match(r"[A-Za-z0-9_](?![?*]|\{0)", rest))


def java(pattern: str, ignore_case: bool = True) -> str:
    """A rule's pattern as a Java pattern with ASCII word boundaries."""
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m[1] + (BEFORE_WORD if _word_follows(pattern, m.end()) else EDGE), pattern)
    return f"(?i){out}" if ignore_case else out


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java(pattern, ignore_case))


def sql_matches(text: str, pattern: str, ignore_case: bool = True) -> str:
    """DuckDB's counterpart of matches()."""
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({text}, '{quoted}'{', ' + chr(39) + 'i' + chr(39) if ignore_case else ''})"


def lines(content: Column) -> Column:
    r"""A text's lines; they end in \n or \r\n."""
    return F.split(content, "\r?\n", -1)


def strip(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def shannon_entropy(value: Column) -> Column:
    """Bits per character over the value's own characters; 0 for the empty string."""
    n = F.length(value).cast("double")
    distinct = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    total = F.aggregate(F.transform(distinct, lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)
    return F.when(n == 0, F.lit(0.0)).otherwise(total)


def sql_entropy(v: str) -> str:
    p = f"((length({v}) - length(replace({v}, c, '')))::DOUBLE / length({v}))"
    return f"CASE WHEN length({v}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -{p} * log2({p}))) END"


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*(?://|#|\*|/\*)")


def truncate(text: Column, size: int = 160) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size - 3)), F.lit("..."))).otherwise(text)


def mask_snippet(line: Column, match: Column) -> Column:
    """The line with a match of 8 characters or more masked to its first 4 and last 2, cut to 160."""
    masked = F.concat(F.left(match, F.lit(4)), F.lit("****"), F.right(match, F.lit(2)))
    return truncate(F.when(F.length(match) >= 8, F.replace(line, match, masked)).otherwise(line))


def fingerprint(rule_id: Column, file: Column, snippet: Column) -> Column:
    """A finding's identity: 16 hex digits of SHA-1 over rule, file and trimmed snippet."""
    return F.left(F.sha1(F.concat_ws(" ", rule_id, file, strip(F.coalesce(snippet, F.lit("")))).cast("binary")), F.lit(16))


def glob_to_regex(glob: str) -> str:
    """A path glob (``*``, ``**``, ``**/``) as an anchored pattern."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}
    return "^" + "".join(parts.get(p) or re.escape(p) for p in re.split(r"(\*\*/|\*\*|\*)", glob) if p) + "$"


#: What stands for a secret without being one.
PLACEHOLDER = r"^(x{3,}|changeme|your[_-]?|example|placeholder|dummy|test|sample|\.\.\.|<|\{\{|\$\{|process\.env|import\.meta|os\.environ|todo|none|null|undefined|redacted|\*{3,})"
ENV_REFERENCE = r"\$\{|process\.env|import\.meta\.env|os\.environ"
PUBLIC_KEY_VALUE = r"AIza[0-9A-Za-z\-_]{20,}"
PUBLIC_KEY_NAME = r"\b(anon|public|publishable|NEXT_PUBLIC|VITE_|REACT_APP_)\w*\s*[:=]"
ANON_KEY = r"supabase\w*anon|anon\w*key"


def looks_like_placeholder(value: Column) -> Column:
    v = strip(value)
    return value.isNull() | (F.length(v) < 6) | matches(v, PLACEHOLDER) | matches(v, ENV_REFERENCE, False)


def is_public_key(line: Column, value: Column) -> Column:
    """Keys that are made to be public: browser keys, anonymous and publishable names."""
    return matches(value, PUBLIC_KEY_VALUE, False) | matches(line, PUBLIC_KEY_NAME) | matches(line, ANON_KEY)


def _needed(parsed, most: int = 24) -> set[str] | None:
    """Lower-case literals of which every match of a parsed pattern has one; the choice with the longest shortest."""
    from re import _constants as c

    best: set[str] | None = None

    def offer(found):
        nonlocal best
        if found and all(len(x) >= 3 for x in found) and len(found) <= most:
            rank = lambda x: (min(map(len, x)), -len(x))
            best = found if best is None or rank(found) > rank(best) else best

    run = ""
    for op, arg in [*parsed, (None, None)]:
        if op is c.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        offer({run} if run else None)
        run = ""
        if op is c.SUBPATTERN:
            offer(_needed(arg[3], most))
        elif op is c.BRANCH:
            each = [_needed(x, most) for x in arg[1]]
            offer(set().union(*each) if all(each) else None)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] >= 1:
            offer(_needed(arg[2], most))
        elif op is c.ATOMIC_GROUP:
            offer(_needed(arg, most))
    return best


def needed_literals(pattern: str) -> set[str] | None:
    """Literals (lower case, three characters or more) of which every match has one; None where no such set is plain.

    Lower-casing a text can't hide one of them, as only ASCII letters are looked at.
    """
    from re import _parser

    return _needed(_parser.parse(pattern, re.A))
