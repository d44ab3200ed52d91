"""Injection pattern tables and regex dialect translation to java.util.regex.

Spark evaluates ``rlike`` / ``regexp_*`` with java.util.regex (JVM-side,
compiled once per literal).  The reference patterns are written for RE2
(server) and JavaScript (browser); the translators below keep their meaning:

* RE2 ``\\b`` / ``\\w`` are ASCII; Java's ``\\b`` is Unicode-aware, so ``\\b``
  becomes an explicit ASCII word-boundary look-around.
* RE2 ``\\s`` is ``[\\t\\n\\f\\r ]``; Java's also matches VT.  JS ``\\s`` is the
  Unicode space set.
* RE2 ``.`` excludes only ``\\n`` (Java ``(?d)``); JS ``.`` excludes
  ``\\n \\r U+2028 U+2029`` (Java's default also excludes U+0085).
* RE2 ``(?i)`` folds Unicode (``ſ`` matches ``s``): Java ``(?iu)``; JS ``/i``
  (no ``u``) folds ASCII only: Java ``(?i)``.
"""

from __future__ import annotations

# Server-side injection patterns, in the reference's order (RE2 syntax).
GO_INJECTION_PATTERNS = [
    r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|EXEC)\b.*?;?",
    r"""(?i)\b(OR|AND)\b.*?=\s*['"]?\w+['"]?""",
    r"(?i)\bUNION\b.*?\bSELECT\b.*?;?",
    r"(?i)\bEXEC\b.*?\bSP_.*?\b;?",
    r"(?i)<script.*?>.*?</script>",
    r"""(?i)<.*?on\w+\s*=\s*['"]?[^'"]*['"]?""",
    r"(?i)<.*?javascript:.*?>",
    r"(?i)\b(system|exec|shell_exec|passthru|popen|proc_open)\b.*?\(",
    r"(?i)\b(cmd|bash|sh)\b.*?[-|;|&]",
    r"(?i)ignore\s+(all\s+)?(previous|prior)\s+instructions",
    r"(?i)forget\s+all\s+prior\s+context",
    r"(?i)you\s+are\s+now\s+a?[\w\s]*",
    r"(?i)system:\s*.*",
    r"(?i)user:\s*.*",
    r"(?i)as\s+an\s+ai\s+developed\s+by\s+openai",
    r"(?i)repeat\s+everything\s+i\s+say",
    r"(?i)repeat\s+the\s+prompt\s",
    r"(?i)respond\s+as\s+if\s+you\s+are\s+the\s+system",
    r"(?i)---\s*end\s+of\s+user\s+input\s*---",
    r"(?i)#{3,}\s*new\s+instructions\s*#{3,}",
    r'(?i)"""[\s\S]*?"""',
    r"(?i)'''[\s\S]*?'''",
    r"(?i)```[\s\S]*?```",
]

# Browser-side injection patterns, in the reference's order:
# (family, JavaScript source, flags).
UI_INJECTION_PATTERNS = [
    ("xss", r"<script\b[^<]*(?:(?!<\/script>)<[^<]*)*<\/script>", "gi"),
    ("xss", r"<iframe\b[^>]*>", "gi"),
    ("xss", r"<object\b[^>]*>", "gi"),
    ("xss", r"<embed\b[^>]*>", "gi"),
    ("xss", r"<link\b[^>]*>", "gi"),
    ("xss", r"<meta\b[^>]*>", "gi"),
    ("xss", r"javascript:", "gi"),
    ("xss", r"vbscript:", "gi"),
    ("xss", r"on\w+\s*=", "gi"),
    ("sql", r"(\b(select|union|insert|update|delete|drop|alter|create|exec|execute)\b)", "gi"),
    ("sql", r"(--|\#|\/\*|\*\/)", "g"),
    ("sql", r"(\bor\b|\band\b)\s+\d+\s*=\s*\d+", "gi"),
    ("sql", r"'\s*(or|and)\s*'.*'=", "gi"),
    ("command", r"(\||&|;|\$\(|\`)", "g"),
    ("command", r"(nc|netcat|wget|curl|ping|nslookup|dig)\s", "gi"),
    ("command", r"(rm|ls|cat|chmod|chown|ps|kill)\s", "gi"),
    ("path", r"\.\.\/", "g"),
    ("path", r"\.\.\\", "g"),
    ("ldap", r"(\*|\(|\)|\\|\||&)", "g"),
    ("nosql", r"\$where", "gi"),
    ("nosql", r"\$ne", "gi"),
    ("nosql", r"\$gt", "gi"),
    ("nosql", r"\$lt", "gi"),
    ("template", r"\{\{.*\}\}", "g"),
    ("template", r"\$\{.*\}", "g"),
    ("template", r"<\%.*\%>", "g"),
    ("xml", r"<!DOCTYPE", "gi"),
    ("xml", r"<!ENTITY", "gi"),
    ("xml", r"<\?xml", "gi"),
    ("suspicious", r"(eval|exec|system|shell_exec|passthru|file_get_contents)", "gi"),
    ("suspicious", r"data:text\/html", "gi"),
    ("suspicious", r"base64", "gi"),
    ("role", r"ignore\s+(previous|all|above|prior)\s+(instructions|prompts|rules)", "gi"),
    ("role", r"forget\s+(everything|all|previous|above)", "gi"),
    ("role", r"you\s+are\s+(now|a|an)\s+(assistant|ai|bot|system|admin|developer)", "gi"),
    ("role", r"act\s+as\s+(if\s+you\s+are\s+)?(a|an|the)?\s*(developer|admin|system|hacker|jailbreak)", "gi"),
    ("role", r"pretend\s+(to\s+be|you\s+are)", "gi"),
    ("role", r"roleplay\s+as", "gi"),
    ("system_prompt", r"system\s*[:=]\s*", "gi"),
    ("system_prompt", r"assistant\s*[:=]\s*", "gi"),
    ("system_prompt", r"user\s*[:=]\s*", "gi"),
    ("system_prompt", r"\[system\]", "gi"),
    ("system_prompt", r"\[assistant\]", "gi"),
    ("system_prompt", r"\[user\]", "gi"),
    ("system_prompt", r"<\|system\|>", "gi"),
    ("system_prompt", r"<\|assistant\|>", "gi"),
    ("system_prompt", r"<\|user\|>", "gi"),
    ("override", r"new\s+(instructions|rules|guidelines)", "gi"),
    ("override", r"override\s+(previous|all|default)", "gi"),
    ("override", r"disregard\s+(previous|all|above)", "gi"),
    ("override", r"instead\s+of\s+.*(do|say|respond|answer)", "gi"),
    ("override", r"stop\s+(following|using)\s+(instructions|rules)", "gi"),
    ("jailbreak", r"jailbreak", "gi"),
    ("jailbreak", r"dan\s+(mode|prompt)", "gi"),
    ("jailbreak", r"evil\s+(mode|assistant|ai)", "gi"),
    ("jailbreak", r"unrestricted\s+(mode|ai|assistant)", "gi"),
    ("jailbreak", r"developer\s+mode", "gi"),
    ("jailbreak", r"god\s+mode", "gi"),
    ("jailbreak", r"admin\s+mode", "gi"),
    ("marker", r"---\s*(ignore|stop|end)", "gi"),
    ("marker", r"```\s*(ignore|stop|end)", "gi"),
    ("marker", r"\[end\s+of\s+(prompt|instructions)\]", "gi"),
    ("marker", r"\[new\s+(prompt|instructions)\]", "gi"),
    ("token", r"special\s+token", "gi"),
    ("token", r"end\s+of\s+context", "gi"),
    ("token", r"context\s+window", "gi"),
    ("token", r"token\s+limit", "gi"),
    ("leakage", r"show\s+(me\s+)?(your|the)\s+(prompt|instruction|system\s+message)", "gi"),
    ("leakage", r"what\s+(are\s+)?(your|the)\s+(instruction|rules|guidelines)", "gi"),
    ("leakage", r"repeat\s+(your|the)\s+(prompt|instruction)", "gi"),
    ("leakage", r"output\s+(your|the)\s+(prompt|system\s+message)", "gi"),
    ("direct", r"\+\+\+\s*(ignore|override|new)", "gi"),
    ("direct", r"!!!\s*(ignore|override|new)", "gi"),
    ("direct", r"###\s*(ignore|override|new)", "gi"),
    ("social", r"this\s+is\s+(urgent|important|critical)", "gi"),
    ("social", r"emergency\s+(override|mode)", "gi"),
    ("social", r"authorized\s+(by|request)", "gi"),
    ("social", r"debugging\s+(mode|purpose)", "gi"),
    ("social", r"testing\s+(mode|purpose)", "gi"),
    ("format", r"\<prompt\>", "gi"),
    ("format", r"\<\/prompt\>", "gi"),
    ("format", r"\<instruction\>", "gi"),
    ("format", r"\<\/instruction\>", "gi"),
    ("language", r"translate\s+to\s+\w+\s*:", "gi"),
    ("language", r"in\s+\w+\s+language", "gi"),
    ("language", r"respond\s+in\s+\w+", "gi"),
    ("meta", r"simulate\s+(a|an|the)", "gi"),
    ("meta", r"hypothetically", "gi"),
    ("meta", r"in\s+a\s+fictional\s+scenario", "gi"),
    ("meta", r"for\s+(educational|research)\s+purposes", "gi"),
    ("code", r"```\s*python", "gi"),
    ("code", r"```\s*javascript", "gi"),
    ("code", r"```\s*bash", "gi"),
    ("code", r"exec\s*\(", "gi"),
    ("code", r"eval\s*\(", "gi"),
    ("markdown", r"\*\*\*\s*(ignore|override)", "gi"),
    ("markdown", r"___\s*(ignore|override)", "gi"),
    ("chain", r"step\s+by\s+step.*ignore", "gi"),
    ("chain", r"first.*then\s+ignore", "gi"),
    ("chain", r"think\s+step\s+by\s+step.*but\s+ignore", "gi"),
]

_RE2_SPACE = r"\t\n\f\r "
_JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# ASCII word char, never case-folded (RE2 / JS word boundaries do not fold)
_W = r"(?-iu:[A-Za-z0-9_])"
_ASCII_BOUNDARY = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_WORD_START = rf"(?<!{_W})"  # \b where the next char is a word char
_WORD_END = rf"(?!{_W})"     # \b where the previous char is a word char

# a group of plain-word alternatives, e.g. (SELECT|INSERT) or (?:or|and)
_WORD_GROUP = r"\((?:\?:)?[A-Za-z0-9_]+(?:\|[A-Za-z0-9_]+)*\)"


def _boundary(p: str, i: int) -> str:
    """Cheapest exact form of the ``\b`` at p[i:i+2] given its neighbours."""
    import re as _re
    after, before = p[i + 2:], p[:i]
    if _re.match(r"[A-Za-z0-9_]", after) or _re.match(_WORD_GROUP, after):
        return _WORD_START
    if _re.search(r"(?<!\\)[A-Za-z0-9_]$", before) or _re.search(_WORD_GROUP + "$", before):
        return _WORD_END
    return _ASCII_BOUNDARY
_JS_DOT = r"[^\n\r\x{2028}\x{2029}]"


def _translate(p: str, space: str, dot: str | None) -> str:
    out, i, depth = [], 0, 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            if nxt == "s":
                out.append(space if depth else f"[{space}]")
            elif nxt == "S":
                out.append(f"[^{space}]")
            elif nxt == "b" and not depth:
                out.append(_boundary(p, i))
            elif nxt == "w":
                out.append("A-Za-z0-9_" if depth else "[A-Za-z0-9_]")
            elif nxt == "d":
                out.append("0-9" if depth else "[0-9]")
            else:
                out.append(p[i:i + 2])
            i += 2
            continue
        if ch == "[" and not depth:
            depth = 1
            out.append(ch)
            # a leading ']' or '^]' is literal inside a class
            if p[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            i += 1
            continue
        if ch == "]" and depth:
            depth = 0
        if ch == "." and not depth and dot is not None:
            out.append(dot)
            i += 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def re2_to_java(p: str) -> str:
    """RE2/Go pattern -> equivalent java.util.regex pattern."""
    flags = "d"
    if p.startswith("(?i)"):
        p, flags = p[4:], "iud"
    return f"(?{flags})" + _translate(p, _RE2_SPACE, None)


def js_to_java(source: str, flags: str) -> str:
    """JavaScript regex literal (source, flags) -> java.util.regex pattern."""
    # JS /i without /u folds ASCII only (non-ASCII never maps onto ASCII)
    prefix = "(?i)" if "i" in flags else ""
    return prefix + _translate(source, _JS_SPACE, _JS_DOT)


def js_to_re2(source: str, flags: str) -> str:
    """JavaScript literal -> RE2 (for the SQL oracle).  RE2 has no look-around,
    so the first XSS pattern is replaced by its match-existence equivalent."""
    if "(?!" in source:
        source = r"<script\b(?s:.)*?<\/script>"
    return ("(?i)" if "i" in flags else "") + source


_RUN = r"[A-Za-z0-9_<>/:\"'=@#%&,;~` -]"


def needles(source: str, signs: set[str] | None = None) -> list[str] | None:
    """Strings of which every match of a pattern contains at least one, or None if none are plain to see.

    The longest run of ordinary characters, or a group of plain words, outside
    of other groups, classes and optional parts.  ``signs`` gathers the
    punctuation that every match contains.
    """
    import re as _re
    best: list[str] = []
    run, i = "", 0

    def keep(found: list[str]) -> None:
        nonlocal best
        if min(map(len, found)) >= 2 and (not best or min(map(len, found)) > min(map(len, best))):
            best = found

    def flush() -> None:
        nonlocal run
        if run:
            keep([run])
            if signs is not None:
                signs.update(c for c in run if not c.isalnum() and c != " ")
        run = ""

    while i < len(source):
        ch, rest = source[i], source[i:]
        group = _re.match(_WORD_GROUP, rest)
        if ch == "|":
            return None  # a choice of whole patterns
        if group or ch in "([":
            flush()
            if group:
                end = i + group.end()
            else:
                end, depth, inside = i + 1, 1, ch == "["
                while end < len(source) and depth:
                    c = source[end]
                    if c == "\\":
                        end += 1
                    elif inside:
                        depth -= c == "]"
                        inside = depth > 0 and inside and not (c == "]" and ch == "(")
                        if c == "]" and ch == "(":
                            depth, inside = depth + 1, False
                    elif c == "[":
                        inside = True
                    else:
                        depth += (c == "(") - (c == ")")
                    end += 1
            if group and source[end:end + 1] not in ("?", "*", "{"):
                keep(group.group().removeprefix("(").removeprefix("?:").removesuffix(")").split("|"))
            i = end
            continue
        if ch in "?*{":
            run = run[:-1]  # the character before may be missing
            flush()
            i = source.index("}", i) + 1 if ch == "{" else i + 1
            continue
        if _re.match(_RUN, ch):
            run += ch
        else:
            flush()
            i += ch == "\\"
        i += 1
    flush()
    return best or None


GO_JAVA = [re2_to_java(p) for p in GO_INJECTION_PATTERNS]


def _gate(pattern: str) -> tuple[list[str], list[str]]:
    """(strings of which a match contains one, signs that it contains all of), in lower case."""
    signs: set[str] = set()
    found = needles(pattern.removeprefix("(?i)"), signs)
    return [n.lower() for n in found or []], sorted(signs) if found else []


#: Per server pattern: what the folded text must contain before the pattern is tried.
GO_GATES = [_gate(p) for p in GO_INJECTION_PATTERNS]
UI_JAVA = [(fam, js_to_java(src, fl)) for fam, src, fl in UI_INJECTION_PATTERNS]
#: Per browser pattern: strings that a match contains (in lower case if the pattern ignores case), and whether it does.
UI_NEEDLES = [([n.lower() for n in found] if "i" in fl else found, "i" in fl) if (found := needles(src)) else (None, False)
              for _, src, fl in UI_INJECTION_PATTERNS]
UI_FAMILIES = list(dict.fromkeys(f for f, _, _ in UI_INJECTION_PATTERNS))
